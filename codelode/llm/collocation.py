"""Collocations: frequent phrases counted in tiles of frequency-ranked ids, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.chunks import give_back, slices
from codelode.llm.common import arrow_rows, forget, running_sum, stored
from codelode.llm.hashing import text_bytes, word_spans

#: Bytes of text in a block of documents.
BLOCK_BYTES = 4 << 20
#: A tile spans this many ranks each way; its cells are counted directly when at least one in SPARSE is hit.
TILE, SPARSE = 1 << 10, 16
#: What is added up together: the cells of a region of tiles from so many neighbouring tasks, and so many neighbouring blocks of a task.
TASKS, TURNS = 8, 4

_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?"]] = True
_SPLIT[10:14] = True
_BLANK = _SPLIT.copy()
_BLANK[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Local ids of all words of the texts in order, -1 between pieces and between texts; and the distinct words."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, _ = word_spans(data, offsets, _BLANK)
    size = ends - starts
    kept = data[~_BLANK[data]]
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.cumsum(_SPLIT[data])[starts] if len(starts) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right")
    breaks = np.flatnonzero((np.diff(piece) != 0) | (np.diff(text) != 0)) + 1
    return np.insert(ids, breaks, -1), words.dictionary


def _row(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    task, turn = TaskContext.get(), 0
    part = task.partitionId() if task else 0
    for batch in slices(batches, 1, block_bytes):
        for lang in pa.compute.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pa.compute.equal(batch.column(0), lang))
            ids, words = _coded(texts)
            counts = np.bincount(ids[ids >= 0], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([part], pa.int64()), pa.array([turn], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), _row(counts, pa.int64()), _row(ids, pa.int32())],
                names=["lang", "part", "turn", "words", "counts", "ids"],
            )
            del ids, words, counts, texts
        turn += 1
        give_back()


_BLOCK_KEY = ["lang", "part", "turn"]
_SEQUENCES = "lang string, part long, turn long, words array<int>, grams array<int>"
_REGION = ["of_high", "of_low", "slot"]
_CELLS = "lang string, part long, turn long, of_high int, of_low int, slot int, high array<int>, low array<int>, sizes array<int>, cells array<int>, times array<long>"
#: The same of one block, whose counts are small.
_COUNTED = _CELLS.replace("times array<long>", "times array<int>")
_TILES = ["lang", "part", "turn", "high", "low", "cells", "times"]
#: A row holds megabytes, so files of blocks are cut into row groups by bytes, whatever the number of rows.
_BY_BYTES = {"parquet.block.size": 4 * BLOCK_BYTES, "parquet.page.size.row.check.min": 1}


def _one(table: pa.Table, name: str) -> np.ndarray:
    """The array of the only row."""
    return table[name].chunk(0).flatten().to_numpy(zero_copy_only=False)


def _sequences(block: pa.Table, words: np.ndarray, grams: np.ndarray | None) -> pa.Table:
    """A block's row; no ``grams`` where they are the words."""
    key = [block[c].combine_chunks() for c in _BLOCK_KEY]
    longer = pa.nulls(1, pa.list_(pa.int32())) if grams is None else _row(grams, pa.int32())
    return pa.table([*key, _row(words, pa.int32()), longer], names=[c.split()[0] for c in _SEQUENCES.split(", ")])


def _sequence(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The words of the only row, and the longer phrases that start at each."""
    words = _one(block, "words")
    return words, words if block["grams"].null_count else _one(block, "grams")


def _ranked(block: pa.Table, ranks: pa.Table) -> pa.Table:
    """A block's words as ranks; -1 for words that are too rare, and between pieces."""
    table = np.full(block["size"][0].as_py() + 1, -1, np.int32)
    table[ranks["k"].to_numpy()] = ranks["id"].to_numpy()
    return _sequences(block, table[_one(block, "ids")], None)


def _joins(words: np.ndarray, grams: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a frequent phrase of ``length`` words starts whose next one is frequent too; and the number of its tile and cell."""
    at = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0))
    return at, _numbers(grams[at].astype(np.int64), words[at + length].astype(np.int64))


def _numbers(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Phrase and last word as one number that sorts by tile first; ids have 31 bits."""
    return (high // TILE) << 41 | (low // TILE) << 20 | (high % TILE) << 10 | low % TILE


def _tiler(length: int):
    """Counts of each block's joins, as the hit cells of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = pa.Table.from_batches([batch.slice(i, 1)])
                _, keys = _joins(*_sequence(block), length)
                keys.sort()
                new = _firsts(keys)
                times, keys = np.diff(np.append(new, len(keys))), keys[new]
                key = [block[c].combine_chunks() for c in _BLOCK_KEY]
                yield from _packed(_by_tile(key, keys, times.astype(np.int32), pa.int32(), _TILES), 0).to_batches()
                del block, keys, times, new
            give_back()

    return run


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, np.diff(values) != 0)) if len(values) else np.zeros(0, np.int64)


def _whole(table: pa.Table, name: str) -> np.ndarray:
    """The arrays of all rows, one after the other."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks])


def _lengths(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([pa.compute.list_value_length(c).to_numpy(zero_copy_only=False) for c in table[name].chunks])


def _keys(table: pa.Table, name: str) -> np.ndarray:
    """The numbers of all cells in the rows of ``table (high, low, <name>, ...)``."""
    tile = table["high"].to_numpy().astype(np.int64) << 41 | table["low"].to_numpy().astype(np.int64) << 20
    return np.repeat(tile, _lengths(table, name)) | _whole(table, name)


def _by_tile(key: list[pa.Array], numbers: np.ndarray, values: np.ndarray, kind: pa.DataType, names: list[str]) -> pa.Table:
    """A row per tile from sorted cells; ``key``: arrays of one value that all rows share."""
    tile = numbers >> 20
    first = _firsts(tile)
    bounds = pa.array(np.append(first, len(tile)).astype(np.int32))
    shared = [pa.array(a.to_pylist() * len(first), a.type) for a in key]
    return pa.table(
        [*shared, pa.array((tile[first] >> 21).astype(np.int32)), pa.array((tile[first] & (1 << 21) - 1).astype(np.int32)),
         pa.ListArray.from_arrays(bounds, pa.array((numbers & (1 << 20) - 1).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(values, kind))],
        names=names,
    )


def _added(tiles: pa.Table) -> pa.Table:
    """The cells of some tiles added up over some blocks: by address in tiles where many are hit, the others sorted together."""
    numbers, times = _keys(tiles, "cells"), _whole(tiles, "times")
    found, hits = np.unique(numbers >> 20, return_counts=True)
    dense = found[hits * SPARSE >= TILE * TILE] if times.sum() < 1 << 53 else found[:0]
    out, totals = [], []
    rest = np.ones(len(numbers), bool)
    for tile in dense.tolist():
        here = (numbers >> 20) == tile
        total = np.bincount(numbers[here] & (1 << 20) - 1, weights=times[here], minlength=TILE * TILE)
        hit = np.flatnonzero(total)
        out.append(tile << 20 | hit)
        totals.append(total[hit].astype(np.int64))
        rest &= ~here
    numbers, times = numbers[rest], times[rest]
    order = np.argsort(numbers, kind="stable")
    numbers, times = numbers[order], times[order]
    new = _firsts(numbers)
    out.append(numbers[new])
    totals.append(np.add.reduceat(times, new) if len(new) else times)
    numbers, times = np.concatenate(out), np.concatenate(totals)
    order = np.argsort(numbers)
    key = [tiles[c].slice(0, 1).combine_chunks() for c in _BLOCK_KEY]
    done = _by_tile(key, numbers[order], times[order], pa.int64(), _TILES)
    del numbers, times, out, totals, order, rest
    give_back()
    return done


def _packed(tiles: pa.Table, level: int) -> pa.Table:
    """Tiles of one block, or of blocks added up, as a row per region: tiles by octaves of their place, which hold about as much each, in
    more parts the more blocks are added up."""
    high, low = tiles["high"].to_numpy().astype(np.int64), tiles["low"].to_numpy().astype(np.int64)
    octave = lambda n: np.frexp(n + 1.0)[1].astype(np.int64) - 1
    region = (octave(high) << 5 | octave(low)) << 32 | (high * 31 + low) % 16**level
    order = np.argsort(region, kind="stable")
    region, tiles = region[order], tiles.take(pa.array(order)).combine_chunks()
    row = _firsts(region)
    sizes = _lengths(tiles, "cells") if len(row) else row
    bounds = np.append(row, len(region))
    ends = pa.array(np.append(0, np.cumsum(sizes))[bounds].astype(np.int32))
    bounds = pa.array(bounds.astype(np.int32))
    of = [pa.array(c.astype(np.int32)) for c in (region[row] >> 37, region[row] >> 32 & 31, region[row] & (1 << 32) - 1)]
    flat = lambda name: pa.concat_arrays([c.flatten() for c in tiles[name].chunks]) if len(row) else pa.array([], tiles[name].type.value_type)
    lists = [pa.ListArray.from_arrays(bounds, pa.array(c.astype(np.int32))) for c in (high[order], low[order], sizes)]
    lists += [pa.ListArray.from_arrays(ends, flat(name)) for name in ("cells", "times")]
    shared = [tiles[c].take(pa.array(row)).combine_chunks() for c in _BLOCK_KEY]
    return pa.table([*shared, *of, *lists], names=[c.split()[0] for c in _CELLS.split(", ")])


def _unpacked(rows: pa.Table, *values: str) -> pa.Table:
    """The tiles in some rows of a region, under the key of their row."""
    tiles = _lengths(rows, "high")
    key = [rows[c].take(pa.array(np.repeat(np.arange(len(tiles)), tiles))).combine_chunks() for c in _BLOCK_KEY]
    ends = pa.array(np.append(0, np.cumsum(_whole(rows, "sizes"))).astype(np.int32))
    place = [pa.array(_whole(rows, c)) for c in ("high", "low")]
    lists = [pa.ListArray.from_arrays(ends, pa.array(_whole(rows, c), pa.int64() if c == "times" else None)) for c in ("cells", *values)]
    return pa.table([*key, *place, *lists], names=[*_TILES[:6], *values])


def _summer(level: int):
    """Sums of a region over some blocks, in the smaller regions of the next ``level``."""

    def run(rows: pa.Table) -> pa.Table:
        done = _packed(_added(_unpacked(rows, "times")), level)
        give_back()
        return done

    return run


def _chooser(least: int):
    """The last sums of a region, as a row per cell that has at least ``least``."""

    def run(rows: pa.Table) -> pa.Table:
        tiles = _added(_unpacked(rows, "times"))
        numbers, times = _keys(tiles, "cells"), _whole(tiles, "times")
        often = times >= least
        numbers, times = numbers[often], times[often]
        high, low = (numbers >> 41) * TILE + (numbers >> 10) % TILE, (numbers >> 20) % (1 << 21) * TILE + numbers % TILE
        langs = pa.array([rows["lang"][0].as_py()] * len(numbers), pa.string())
        return pa.table([langs, pa.array(high.astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(times)], names=["lang", "high", "low", "a"])

    return run


def _frequent(cells: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, high, low, a`` of cells with ``least`` over all blocks, a bounded number of rows added up at a time; and the steps stored for it."""
    steps: list[DataFrame] = []
    part, turn = cells.agg(F.max("part"), F.max("turn")).first()
    part, turn, level = part or 0, turn or 0, 0
    while True:
        part, turn, level = part // TASKS, turn // TURNS, level + 1
        near = cells.withColumns({"part": F.expr(f"part div {TASKS}"), "turn": F.expr(f"turn div {TURNS}")})
        near = near.groupBy("lang", *_REGION, "part", "turn")
        if not part and not turn:
            return near.applyInArrow(_chooser(least), "lang string, high int, low int, a long"), steps
        cells = stored(near.applyInArrow(_summer(level), _CELLS), "sums")
        forget(*steps)
        steps = [cells]


def _named(left: pa.Table, right: pa.Table) -> pa.Table:
    """The frequent ones among the cells of a region with their ids, one row per block."""
    names = ["lang", "part", "turn", "numbers", "ids"]
    if not left.num_rows or not right.num_rows:
        return pa.table([left[c].slice(0, 0) for c in names[:3]] + [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))], names=names)
    wanted, ids = _whole(right, "numbers"), _whole(right, "ids")
    order = np.argsort(wanted)
    wanted, ids = wanted[order], ids[order]
    tiles = _unpacked(left)
    numbers = _keys(tiles, "cells")
    place = np.minimum(np.searchsorted(wanted, numbers), len(wanted) - 1)
    known = wanted[place] == numbers
    blocks, of = np.unique(np.stack([left["part"].to_numpy(), left["turn"].to_numpy()]), axis=1, return_inverse=True)
    of = np.repeat(of.ravel(), _lengths(left, "cells"))[known]
    order = np.argsort(of, kind="stable")
    bounds = pa.array(np.searchsorted(of[order], np.arange(blocks.shape[1] + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(v[known][order])) for v in (numbers, ids[place])]
    langs = pa.array([left["lang"][0].as_py()] * blocks.shape[1], pa.string())
    return pa.table([langs, pa.array(blocks[0]), pa.array(blocks[1]), *lists], names=names)


def _extender(length: int):
    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        """A block's phrases of one more word as ranks of the frequent ones."""
        words, grams = _sequence(block)
        out = np.full(len(grams), -1, np.int32)
        if known.num_rows:
            at, keys = _joins(words, grams, length)
            wanted, ids = _whole(known, "numbers"), _whole(known, "ids")
            if len(wanted) and len(at):
                order = np.argsort(wanted)
                wanted, ids = wanted[order], ids[order]
                place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                out[at] = np.where(wanted[place] == keys, ids[place], -1)
        return _sequences(block, words, out)

    return run


def _rank(counts: DataFrame, order: list[str]) -> DataFrame:
    """``id``: the place in its lang by falling count ``a``, from 0; ties in ``order``."""
    counts = counts.withColumn("_falling", -F.col("a"))
    ranked = running_sum(counts, ["lang"], ["_falling", *order], F.lit(1), "id")
    return ranked.withColumn("id", F.col("id").cast("int")).drop("_falling")


def _next(blocks: DataFrame, length: int, least: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Frequent phrases of ``length + 1`` words as ``lang, high, low, a, id`` (phrase before, last word), and the blocks in their ids."""
    with arrow_rows(blocks.sparkSession, 1):
        cells = stored(blocks.mapInArrow(_tiler(length), _COUNTED), "cells")
    sums, steps = _frequent(cells, least)
    grams = stored(_rank(sums, ["high", "low"]), "grams")
    forget(*steps)
    if last:
        forget(cells)
        return grams, None
    # Ids go back the way the counts came: region by region, once for each few blocks, then to the blocks.
    octave = lambda c: F.expr(f"length(bin({c} div {TILE} + 1)) - 1")
    number = f"shiftleft(cast(high div {TILE} as bigint), 41) | shiftleft(cast(low div {TILE} as bigint), 20) | cast((high % {TILE}) * {TILE} + low % {TILE} as bigint)"
    regions = grams.groupBy("lang", octave("high").alias("of_high"), octave("low").alias("of_low")).agg(
        F.collect_list(F.expr(number)).alias("numbers"), F.collect_list("id").alias("ids")
    )
    near = {"tasks": F.expr(f"part div {TASKS}"), "turns": F.expr(f"turn div {TURNS}")}
    by = ["lang", "of_high", "of_low", *near]
    few = cells.drop("times", "slot").withColumns(near)
    wanted = few.select(*by).distinct().join(regions, by[:3]).withColumnsRenamed({c: f"in_{c}" for c in by})
    schema = "lang string, part long, turn long, numbers array<long>, ids array<int>"
    known = few.groupBy(*by).cogroup(wanted.groupBy(*[f"in_{c}" for c in by])).applyInArrow(_named, schema)
    known = known.where(F.size("ids") > 0).withColumnsRenamed({c: f"of_{c}" for c in _BLOCK_KEY})
    longer = blocks.groupBy(*_BLOCK_KEY).cogroup(known.groupBy(*[f"of_{c}" for c in _BLOCK_KEY])).applyInArrow(_extender(length), _SEQUENCES)
    longer = stored(longer, "longer", **_BY_BYTES)
    forget(cells)
    return grams, longer


def _exact(value: Column, digits: int = 20) -> Column:
    return value.cast(f"decimal({digits},0)")


def frequent_phrases(docs: DataFrame, least: int, longest: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words, phrases, totals)`` of ``docs (text, lang, ...)``: ``lang, word, a, id`` of words with at least ``least`` occurrences,
    ``lang, ids, a`` of phrases of 1 to ``longest`` words with as many (``ids``: the words' ids), and ``lang, n``, all words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    raw = stored(texts.mapInArrow(lambda b: _blocks(b, block_bytes), "lang string, part long, turn long, words array<string>, counts array<long>, ids array<int>"), "blocks", **_BY_BYTES)
    each = raw.select(*_BLOCK_KEY, F.posexplode(F.arrays_zip("words", "counts")).alias("k", "use"))
    each = each.select(*_BLOCK_KEY, "k", F.col("use.words").alias("word"), F.col("use.counts").alias("n"))
    heard = each.groupBy("lang", "word").agg(F.sum("n").alias("a"))
    words = stored(_rank(heard.where(F.col("a") >= least), ["word"]), "words")
    totals = stored(each.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ranks = each.join(words.select("lang", "word", "id"), ["lang", "word"]).select(
        F.col("lang").alias("of_lang"), F.col("part").alias("of_part"), F.col("turn").alias("of_turn"), "k", "id"
    )
    coded = raw.select(*_BLOCK_KEY, F.size("words").alias("size"), "ids")
    blocks = coded.groupBy(*_BLOCK_KEY).cogroup(ranks.groupBy("of_lang", "of_part", "of_turn")).applyInArrow(_ranked, _SEQUENCES)
    blocks = stored(blocks, "ranked", **_BY_BYTES)
    forget(raw)
    before = words.select("lang", F.array("id").alias("ids"), "a", "id")
    phrases = before.drop("id")
    for length in range(1, longest):
        grams, longer = _next(blocks, length, least, length + 1 == longest)
        forget(blocks)
        before = grams.select("lang", F.col("high").alias("id"), F.col("low"), "a", F.col("id").alias("next")).join(
            before.select("lang", "ids", "id"), ["lang", "id"]
        ).select("lang", F.array_append("ids", F.col("low")).alias("ids"), "a", F.col("next").alias("id"))
        before = stored(before, "phrases")
        phrases = phrases.unionByName(before.drop("id"))
        blocks = longer
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` phrases per lang of ``docs (text, lang, ...)``: ``lang, rank, phrase, a, l, r, n, score``.

    Words are runs between blanks in lower case (A-Z only) inside pieces cut at ``.,;:!?`` and line ends; a null lang is ``und``, a null text
    empty.  Candidates are phrases of 2 to ``longest`` words with ``a >= least`` occurrences.  A cut after k words
    gives ``l`` and ``r``, the occurrences of both parts, and ``floor(2000000 a / (l + r))``; the weakest cut counts, the
    first among equals.  Candidates inside a longer one that has ``percent`` of their occurrences go.

    Words get ranks by frequency.  In blocks of ``block_bytes`` of text, pairs of ranks are counted per tile of the pair plane; tiles travel
    as one row per region of neighbouring tiles, so a block has a bounded number of rows however many tiles it hits.  A region's cells are added up over some blocks at a time by ``bincount``, or sorted where few cells are hit, and the sums likewise, until one
    is left.  Frequent pairs get ranks of their own and are paired with the next word, and so on.  A word or pair that is in every
    document costs a cell per block.  Every row's text counts, also of rows that repeat a doc_id; very long texts are a block
    of their own.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    words, phrases, totals = frequent_phrases(docs, least, longest, block_bytes)
    long = phrases.where(F.size("ids") > 1)
    cut = long.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("right")
    )
    side = lambda name, count: phrases.select("lang", F.col("ids").alias(name), F.col("a").alias(count))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cut.withColumn("score", score.cast("long")).groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n))))
    longer = long.where(F.size("ids") > 2).select("lang", F.explode(inner).alias("ids"), F.col("a").alias("whole"))
    longer = longer.groupBy("lang", "ids").agg(F.max("whole").alias("whole"))
    stay = F.col("whole").isNull() | (100 * _exact(F.col("whole")) < percent * _exact(F.col("a")))
    kept = weakest.join(longer, ["lang", "ids"], "left").where(stay).select("lang", "ids", "a", "w.l", "w.r", "w.score")
    named = kept.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    named = named.groupBy("lang", "ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = named.select("lang", "ids", F.array_join(F.col("words.word"), " ").alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(named, ["lang", "ids"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
