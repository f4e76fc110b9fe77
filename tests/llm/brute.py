"""Plain Python twins of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if fold else text)


def shingle_set(text, size):
    w = words(text, fold=True)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_duplicates(rows, size, percent):
    """rows: (doc_id, text). Returns {doc_id: (n, component)} over unique ids."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    common = {}
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def encoded(text, path_a, path_b, _made={}):
    """Tokens as (id, bytes) under both tokenizers of a space and the text; none where they do not spell it."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not _made:
        _made["a"], _made["b"] = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        _made["a"].encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _made["letters"] = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    a, b, letters = _made["a"], _made["b"], _made["letters"]
    if not text:
        return [], []
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    fine = all(b"".join(t for _, t in side) == whole for side in (one, two))
    return (one, two) if fine else ([], [])


def groups(one, two):
    """Cut both token lists at the offsets where both end."""
    out, a, b, at_a, at_b, j = [], [], [], 0, 0, 0
    for i, token in one:
        a.append(i)
        at_a += len(token)
        while at_b < at_a and j < len(two):
            at_b += len(two[j][1])
            b.append(two[j][0])
            j += 1
        if at_a == at_b:
            out.append((a, b))
            a, b = [], []
    return out


def alignment(rows, path_a, path_b):
    """rows: (doc_id, text). The operator's rows, and the count of each linked pair."""
    import hashlib
    from collections import Counter

    cut = [(i, *encoded(t, path_a, path_b)) for i, t in rows]
    cut = [(i, one, two, groups(one, two)) for i, one, two in cut]
    linked = [[(p, q) for a, b in g for p in a for q in b] for *_, g in cut]
    count = Counter(p for pairs in linked for p in set(pairs))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for (i, one, two, g), pairs in zip(cut, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        best = sum(count[p] == top[p[0]] for p in pairs)
        out.append((i, len(one), len(two), len(g), len(pairs), best, sum(count[p] for p in pairs), digest))
    return out, count


def collocations(rows, least, longest, top, percent=80):
    """rows: (text, lang). The operator's rows."""
    from collections import Counter, defaultdict

    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    count[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        known = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in known.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    inside[g[i : i + n]] = max(inside[g[i : i + n]], a)
        best = []
        for g, a in known.items():
            if 100 * inside[g] >= percent * a:
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out
