"""Class files as nested rows: what one class says, read in one pass over its bytes.

This is the only record-level reader of the engine.  It names what the bytes hold and nothing more;
counting, rendering and relating happen in Spark on the tables exploded from these rows.
"""

from __future__ import annotations

import struct

# --- fixed values: operand bytes by opcode, the rest have none ---------------------------------
OPERANDS = {
    **dict.fromkeys([16, 18, 169, 188, *range(21, 26), *range(54, 59)], 1),
    **dict.fromkeys([17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199], 2),
    197: 3,
    **dict.fromkeys([185, 186, 200, 201], 4),
}
ACC_SYNTHETIC, ACC_RECORD, ACC_DEPRECATED = 0x1000, 0x10000, 0x20000


class Reader:
    """A cursor over big-endian bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, fmt: str):
        values = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(">" + fmt)
        return values if len(values) > 1 else values[0]

    def slice(self, size: int) -> bytes:
        self.at += size
        return self.data[self.at - size : self.at]


def _utf(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Pool:
    """The constant pool: raw entries by index, and the few look-ups code needs."""

    def __init__(self, r: Reader):
        self.size = r.take("H")
        self.items: dict[int, tuple] = {}
        i = 1
        while i < self.size:
            tag = r.take("B")
            if tag == 1:
                value = _utf(r.slice(r.take("H")))
            elif tag in (3, 4, 5, 6):
                value = r.take({3: "i", 4: "f", 5: "q", 6: "d"}[tag])
            elif tag in (7, 8, 16, 19, 20):
                value = r.take("H")
            elif tag in (9, 10, 11, 12, 17, 18):
                value = r.take("HH")
            elif tag == 15:
                value = r.take("BH")
            else:
                raise ValueError(f"constant pool tag {tag} at {i}")
            self.items[i] = (tag, value)
            i += 2 if tag in (5, 6) else 1

    def text(self, i: int) -> str | None:
        """Text of a Utf8 entry, or of the entry it is named by."""
        if i == 0:
            return None
        tag, value = self.items[i]
        return value if tag == 1 else self.text(value)

    def pair(self, i: int) -> tuple[str, str]:
        name, desc = self.items[i][1]
        return self.text(name), self.text(desc)

    def member(self, i: int) -> tuple[str, str, str]:
        owner, pair = self.items[i][1]
        return (self.text(owner), *self.pair(pair))

    def constant(self, i: int) -> dict:
        tag, value = self.items[i]
        if tag in (3, 5):
            return {"const_kind": "int" if tag == 3 else "long", "const_long": value}
        if tag in (4, 6):
            return {"const_kind": "float" if tag == 4 else "double", "const_double": value}
        if tag == 8:
            return {"const_kind": "string", "const_str": self.text(value)}
        if tag == 7:
            name = self.text(value)
            return {"const_kind": "type", "const_str": name if name.startswith("[") else f"L{name};"}
        return {"const_kind": "other", "const_str": self.text(value) if tag == 16 else None}

    def rows(self) -> list[dict]:
        out = []
        for i, (tag, v) in self.items.items():
            row = {"cp_index": i, "tag": tag}
            if tag in (1, 7, 8, 16, 19, 20):
                row.update(text=v if tag == 1 else self.text(v), a=None if tag == 1 else v)
            elif tag in (3, 5):
                row["num"] = v
            elif tag in (4, 6):
                row["real"] = v
            else:
                row.update(a=v[0], b=v[1])
            out.append(row)
        return out


def _attributes(r: Reader, pool: Pool) -> list[tuple[str, bytes]]:
    out = []
    for _ in range(r.take("H")):
        name = pool.text(r.take("H"))
        out.append((name, r.slice(r.take("I"))))
    return out


def _skip_element(r: Reader) -> None:
    tag = chr(r.take("B"))
    if tag == "e":
        r.take("HH")
    elif tag == "@":
        _annotation(r, None)
    elif tag == "[":
        for _ in range(r.take("H")):
            _skip_element(r)
    else:
        r.take("H")


def _annotation(r: Reader, pool: Pool | None) -> str | None:
    kind = r.take("H")
    for _ in range(r.take("H")):
        r.take("H")
        _skip_element(r)
    return pool.text(kind) if pool else None


def _annotations(attrs, pool, target, member="", desc="") -> list[dict]:
    out = []
    for name, raw in attrs:
        if name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            r = Reader(raw)
            for _ in range(r.take("H")):
                out.append(
                    {
                        "target_kind": target, "member": member, "member_desc": desc,
                        "desc": _annotation(r, pool), "visible": "Invisible" not in name,
                    }
                )
    return out


def _access(base: int, attrs) -> int:
    names = {n for n, _ in attrs}
    for attr, bit in (("Synthetic", ACC_SYNTHETIC), ("Record", ACC_RECORD), ("Deprecated", ACC_DEPRECATED)):
        base |= bit if attr in names else 0
    return base


def _bootstraps(attrs, pool: Pool) -> list[tuple[str | None, list[str]]]:
    out = []
    for name, raw in attrs:
        if name == "BootstrapMethods":
            r = Reader(raw)
            for _ in range(r.take("H")):
                handle, count = r.take("HH")
                args = [r.take("H") for _ in range(count)]
                owner = pool.member(pool.items[handle][1][1])[0]
                out.append((owner, [pool.text(a) for a in args if pool.items[a][0] == 8]))
    return out


def _operands(op: int, r: Reader, at: int, pool: Pool, boots) -> tuple[int, dict]:
    """Read one instruction's operands: its opcode in base form and the row fields it sets."""
    if 26 <= op <= 45 or 59 <= op <= 78:
        base, first = (21, 26) if op <= 45 else (54, 59)
        return base + (op - first) // 4, {"const_kind": "var", "const_long": (op - first) % 4}
    if 2 <= op <= 15:
        kind, zero = ("int", 3) if op <= 8 else ("long", 9) if op <= 10 else ("float", 11) if op <= 13 else ("double", 14)
        value = op - zero
        return op, {"const_kind": kind, "const_long" if op <= 10 else "const_double": value}
    if op == 196:
        op, var = r.take("BH")
        if op == 132:
            return op, {"const_kind": "int", "const_long": r.take("h")}
        return op, {"const_kind": "var", "const_long": var}
    if op in (170, 171):
        r.at += -(at + 1) % 4
        default = r.take("i")
        if op == 170:
            low, high = r.take("ii")
            jumps = [r.take("i") for _ in range(high - low + 1)]
        else:
            jumps = [r.take("ii")[1] for _ in range(r.take("i"))]
        return op, {"jump_targets": [at + j for j in (default, *jumps)], "switch_cases": len(jumps)}
    size = OPERANDS.get(op, 0)
    if not size:
        return op, {}
    start, r.at = r.at, r.at + size
    raw = Reader(r.data, start)
    if op in (16, 17, 188):
        return op, {"const_kind": "int", "const_long": raw.take("h" if op == 17 else "B" if op == 188 else "b")}
    if op in (18, 19, 20):
        return 18, pool.constant(raw.take("B" if op == 18 else "H"))
    if op == 132:
        raw.at += 1
        return op, {"const_kind": "int", "const_long": raw.take("b")}
    if 153 <= op <= 168 or op in (198, 199):
        return op, {"jump_targets": [at + raw.take("h")]}
    if op in (200, 201):
        return op - 33, {"jump_targets": [at + raw.take("i")]}
    if 178 <= op <= 185:
        owner, name, desc = pool.member(raw.take("H"))
        return op, {"ref_owner": owner, "ref_name": name, "ref_desc": desc}
    if op == 186:
        boot, pair = pool.items[raw.take("H")][1]
        name, desc = pool.pair(pair)
        owner, strings = boots[boot]
        return op, {"ref_name": name, "ref_desc": desc, "bsm_owner": owner, "bsm_strings": strings}
    if op in (187, 189, 192, 193, 197):
        return op, {"ref_owner": pool.text(raw.take("H"))}
    return op, {"const_kind": "var", "const_long": raw.take("B")}


def _code(raw: bytes, pool: Pool, boots) -> dict:
    """A Code attribute: instruction rows with label and line markers in order, handlers, variable names."""
    r = Reader(raw)
    max_stack, max_locals, size = r.take("HHI")
    body = r.slice(size)
    handlers = [r.take("HHHH") for _ in range(r.take("H"))]
    lines: dict[int, list[int]] = {}
    labels = {p for h in handlers for p in h[:3]}
    variables = []
    for name, attr in _attributes(r, pool):
        a = Reader(attr)
        if name == "LineNumberTable":
            for _ in range(a.take("H")):
                at, line = a.take("HH")
                lines.setdefault(at, []).append(line)
        elif name in ("LocalVariableTable", "LocalVariableTypeTable"):
            for _ in range(a.take("H")):
                at, length, var, _, _ = a.take("HHHHH")
                labels.update((at, at + length))
                if name == "LocalVariableTable":
                    variables.append(pool.text(var))
    labels.update(lines)
    parsed = []
    c = Reader(body)
    while c.at < size:
        at = c.at
        op, fields = _operands(c.take("B"), c, at, pool, boots)
        labels.update(fields.get("jump_targets", ()))
        parsed.append((at, op, fields))
    rows: list[dict] = []
    for at, op, fields in [*parsed, (size, None, {})]:
        if at in labels:
            rows.append({"opcode": -1, "pseudo_kind": "LABEL", "label": at})
        rows.extend({"opcode": -1, "pseudo_kind": "LINE", "line": n} for n in lines.get(at, ()))
        if op is not None:
            rows.append({"opcode": op, **fields})
    for i, row in enumerate(rows):
        row["idx"] = i
        row.setdefault("jump_targets", [])
    return {
        "max_stack": max_stack, "max_locals": max_locals, "code": rows, "local_vars": variables,
        "try_catch": [{"start_label": s, "end_label": e, "handler_label": h} for s, e, h, _ in handlers],
    }


def _module(raw: bytes, pool: Pool) -> dict:
    r = Reader(raw)
    name, access, version = r.take("HHH")
    texts = lambda: [pool.text(r.take("H")) for _ in range(r.take("H"))]

    def requires():
        module, acc, ver = r.take("HHH")
        return {"module": pool.text(module), "access": acc, "version": pool.text(ver)}

    def opened():
        package, acc = r.take("HH")
        return {"package": pool.text(package), "access": acc, "modules": texts()}

    many = lambda one: [one() for _ in range(r.take("H"))]
    return {
        "name": pool.text(name), "version": pool.text(version), "access": access,
        "requires": many(requires), "exports": many(opened), "opens": many(opened), "uses": texts(),
        "provides": many(lambda: {"service": pool.text(r.take("H")), "providers": texts()}),
    }


def decode_class(data: bytes) -> dict:
    """All facts of one class; raises on bytes that are no class file."""
    r = Reader(data)
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("not a class file")
    minor, major = r.take("HH")
    pool = Pool(r)
    access, this, parent = r.take("HHH")
    interfaces = [pool.text(r.take("H")) for _ in range(r.take("H"))]
    members = []
    for _ in range(2):
        group = []
        for _ in range(r.take("H")):
            acc, name, desc = r.take("HHH")
            attrs = _attributes(r, pool)
            group.append((_access(acc, attrs), pool.text(name), pool.text(desc), attrs))
        members.append(group)
    attrs = _attributes(r, pool)
    boots = _bootstraps(attrs, pool)
    by_name = dict(attrs)
    annotations = _annotations(attrs, pool, "class")
    fields, methods = [], []
    for i, (acc, name, desc, own) in enumerate(members[0]):
        constant = dict(own).get("ConstantValue")
        value = pool.constant(struct.unpack(">H", constant)[0]) if constant else {}
        fields.append({"ordinal": i, "name": name, "desc": desc, "access": acc, "attrs": [n for n, _ in own], **value})
        annotations += _annotations(own, pool, "field", name, desc)
    for i, (acc, name, desc, own) in enumerate(members[1]):
        code = dict(own).get("Code")
        body = _code(code, pool, boots) if code else {"code": [], "try_catch": [], "local_vars": [], "max_stack": 0, "max_locals": 0}
        methods.append({"ordinal": i, "name": name, "desc": desc, "access": acc, **body})
        annotations += _annotations(own, pool, "method", name, desc)
    source = by_name.get("SourceFile")
    return {
        "internal_name": pool.text(this), "super_name": pool.text(parent), "interfaces": interfaces,
        "access": _access(access, attrs), "major": major, "minor": minor, "cp_size": pool.size,
        "source_file": pool.text(struct.unpack(">H", source)[0]) if source else None,
        "module_info": _module(by_name["Module"], pool) if "Module" in by_name else None,
        "pool": pool.rows(), "fields": fields, "methods": methods, "annotations": annotations,
    }
