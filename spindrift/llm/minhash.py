"""Weighted MinHash by thrown darts, banded candidates, exact verification and components.

A document is the multiset of its word shingles, a shingle's weight being how often it occurs.
Darts are thrown at rate one per unit of weight and time into the region of each element, at
places drawn from hashes of the element alone, so equal regions get equal darts. A signature
keeps the earliest dart of each coordinate. Time is searched only as far as is needed for every
coordinate to be hit, so a document costs about (elements + K log K) and not elements times K.
Two signatures agree in a coordinate with the probability of the weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_spread, mix64, offsets, ragged, returning_memory, stored
from spindrift.llm.components import components

ROWS, BANDS = 4, 24
SLICE_BYTES = 3 << 19
#: Standard deviations below the expected agreement at the threshold that a candidate may show.
SLACK = 6.0
#: Rows of a bucket that are compared with one another in one group; larger buckets are cut into blocks.
BLOCK = 512
#: Pairs compared at once.
PAIRS = 1 << 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased white-space separated word, and how many each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
    words = lists.flatten().dictionary_encode()
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    code = words.indices.to_numpy(zero_copy_only=False)
    real = (np.array(pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)) > 0)[code] if len(code) else np.zeros(0, dtype=bool)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = offsets(counts)
    kept = offsets(real.astype(np.int64))
    return of[code[real]], kept[ends[1:]] - kept[ends[:-1]]


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text (sorted), their counts, and how many each text has.

    A text of one to ``size`` words is one shingle; a text without words has none.
    """
    words, n_words = _word_hashes(texts)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    first = ragged(offsets(n_words)[:-1], n)
    last = np.repeat(offsets(n_words)[1:], n)
    h = np.full(len(first), 0x51ED27, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            inside = first + i < last
            h[inside] = mix64(h[inside] * _GOLD + words[first[inside] + i])
    ends = offsets(n)
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[ends[:-1][n > 0]] = True
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    firsts = offsets(new.astype(np.int64))
    return h[at], weight, firsts[ends[1:]] - firsts[ends[:-1]]


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Dart signatures, one row of ``k`` values per set; sets without elements keep zeros.

    ``weights`` are positive numbers. Weight is split into columns [0, 1), [1, 2), [2, 4), ...;
    a column is hit at the rate of its width, and hits above an element's weight do not count.
    """
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    # elements reach into one column or more
    columns = np.maximum(1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
    unit = np.repeat(np.arange(len(elements)), columns)
    column = np.arange(len(unit)) - np.repeat(offsets(columns)[:-1], columns)
    low = np.where(column > 0, 2.0 ** (column - 1), 0.0)
    width = np.where(column > 0, low, 1.0)
    partly = weights[unit] < low + width
    with np.errstate(over="ignore"):
        seed = mix64(elements[unit] + column.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    whose = owner[unit]
    total = np.bincount(owner, weights=weights, minlength=n)

    best = np.full(n * k, np.inf)
    value = np.zeros(n * k, dtype=np.uint64)
    limit = np.zeros(n)
    some = total > 0
    limit[some] = k * (np.log(k) + 3.0) / total[some]
    todo = some.copy()
    while todo.any():
        at = np.flatnonzero(todo[whose])
        best[np.repeat(todo, k)] = np.inf
        time = np.zeros(len(at))
        draw = seed[at]
        while len(at):
            draw = mix64(draw)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[at]
            live = time < limit[whose[at]]
            at, time, draw = at[live], time[live], draw[live]
            dart = mix64(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            # place on the weight axis, then the coordinate
            inside = np.ones(len(at), dtype=bool)
            check = np.flatnonzero(partly[at])
            place = low[at[check]] + width[at[check]] * ((dart[check] >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            inside[check] = place < weights[unit[at[check]]]
            cell = whose[at[inside]] * k + (mix64(dart[inside]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, time[inside])
            first = time[inside] == best[cell]
            value[cell[first]] = dart[inside][first]
        todo = some & np.isinf(best.reshape(n, k)).any(axis=1)
        limit[todo] *= 2
    return value.reshape(n, k)


def bands(signature: np.ndarray, rows: int, n_bands: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    with np.errstate(over="ignore"):
        key = np.repeat(mix64(np.arange(n_bands, dtype=np.uint64))[None, :], len(signature), axis=0)
        for i in range(rows):
            key = mix64(key * _GOLD + signature[:, i : i + rows * n_bands : rows])
    return key


def _slices(texts: list[str | None]):
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _sign(size: int, rows: int, n_bands: int):
    def sign(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in _slices(texts):
                h, weight, counts = shingles([t or "" for t in texts[first:last]], size)
                signature = signatures(h, weight.astype(np.float64), counts, rows * n_bands)
                ends = offsets(counts).tolist()
                content = [xxhash.xxh3_128_digest(h[i:j].tobytes() + weight[i:j].tobytes()) if j > i else None for i, j in zip(ends, ends[1:], strict=False)]
                keys = bands(signature, rows, n_bands).view(np.int64)
                low = (signature & np.uint64(0xFF)).astype(np.uint8)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * n_bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.array(content, pa.binary()), listed, pa.array([x.tobytes() for x in low], pa.binary())],
                    names=["id", "content", "bands", "sketch"],
                )

    return returning_memory(sign)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(h1, h2), max(0, len(h1) - 1))
    same = h1[at] == h2 if len(h1) else np.zeros(len(h2), dtype=bool)
    shared = np.minimum(w1[at[same]], w2[same]).sum() if same.any() else 0
    return float(shared / (w1.sum() + w2.sum() - shared)) if len(h1) or len(h2) else 0.0


def _verify(size: int, threshold: float):
    def verify(batches):
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for first, last in _slices([(x or "") + (y or "") for x, y in zip(left, right, strict=True)]):
                distinct = list(dict.fromkeys(t or "" for t in left[first:last] + right[first:last]))
                place = {t: i for i, t in enumerate(distinct)}
                h, weight, counts = shingles(distinct, size)
                ends = offsets(counts)
                for x, y in zip(left[first:last], right[first:last], strict=True):
                    i, j = (slice(ends[p], ends[p + 1]) for p in (place[x or ""], place[y or ""]))
                    keep.append(weighted_jaccard(h[i], weight[i], h[j], weight[j]) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return returning_memory(verify)


def _agree(least: int):
    def agree(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            near = (x == y).sum(axis=1) >= least if b.num_rows else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in b.columns[:2]], names=["a", "b"])

    return returning_memory(agree)


def _units(size: int):
    """Texts as sets: the c-th occurrence of a shingle is an element of its own, so that the
    Jaccard similarity of the sets is the weighted one of the texts."""

    def units(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in _slices(texts):
                h, weight, counts = shingles([t or "" for t in texts[first:last]], size)
                nth = np.arange(int(weight.sum())) - np.repeat(offsets(weight)[:-1], weight)
                with np.errstate(over="ignore"):
                    element = np.repeat(h, weight) ^ mix64(nth.astype(np.uint64)) * (nth > 0)
                sums = offsets(weight)[offsets(counts)].tolist()
                sets = [np.unique(element[i:j]).tobytes() for i, j in zip(sums, sums[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(sets, pa.binary())], names=["id", "units"])

    return returning_memory(units)


def _near(t: pa.Table, least: int):
    """Pairs (x, y) of row numbers of each group (rows sorted by group) with two labels and similar
    sketches, each only in the first band that both have in common; some pairs at a time."""
    group, own, across, band, label = (t.column(c).to_numpy() for c in ("group", "own", "across", "band", "label"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, t.num_rows)
    later = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(t.num_rows) - 1
    upto, at = offsets(later), 0
    while at < t.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        x, y = np.repeat(np.arange(at, to), later[at:to]), ragged(np.arange(at, to) + 1, later[at:to])
        use = (label[x] != label[y]) & (~across[x] | (own[x] != own[y]))
        x, y = x[use], y[use]
        near = (sketch[x] == sketch[y]).sum(axis=1) >= least
        x, y = x[near], y[near]
        first = (bands[x] == bands[y]).argmax(axis=1) == band[x]
        yield x[first], y[first]
        at = to


def _by_group(compare):
    """Give ``compare`` tables of whole groups out of batches sorted by group."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            group = t.column("group").to_numpy()
            last = int(np.searchsorted(group, group[-1], side="left")) if len(group) else 0
            held = t.slice(last)
            if last:
                yield from compare(t.slice(0, last))
        if held is not None and held.num_rows:
            yield from compare(held)

    return returning_memory(run)


def _candidates(least: int):
    """The rows (group, id) that are near another row of their group by sketch."""

    def compare(t: pa.Table):
        some = np.zeros(t.num_rows, dtype=bool)
        for x, y in _near(t, least):
            some[x] = some[y] = True
        mine = t.filter(pa.array(some)).select(["group", "id"])
        yield from mine.to_batches()

    return _by_group(compare)


def _open_links(least: int, threshold: float):
    """Of rows with their sets (``units``): the similar pairs of two labels."""

    def compare(t: pa.Table):
        units = [np.frombuffer(u, dtype=np.uint64) for u in t.column("units").to_pylist()]
        ids = t.column("id").combine_chunks()
        for x, y in _near(t, least):
            keep = [(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if _jaccard(units[i], units[j]) >= threshold]
            if keep:
                x, y = (pa.array(c) for c in zip(*keep, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(x), ids.take(y)], names=["a", "b"])

    return _by_group(compare)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """``<id_col>``, ``component_id``, ``group_size`` and ``kept`` for every row.

    Documents are linked if the weighted Jaccard similarity of their shingles of ``shingle`` words
    (lower-cased, separated by white space, weighted by their count) is at least ``threshold``;
    groups are the components of all links, named by their smallest id, and that document is kept.
    Every link is checked exactly. A pair at the threshold meets in a band with probability
    1 - (1 - threshold^rows)^n_bands, 0.999997 by default, and more similar pairs more surely.

    Texts of fewer words than ``shingle`` are one shingle. Null texts, empty texts and texts
    without words link with nothing and stay. Rows without an id stay, with a null component.
    Rows that repeat an id with one text count once; with different texts they all get the smallest
    component that any of them reaches. Copies are one node, so a group of copies never meets
    itself in pairs. An empty table gives an empty result; other columns are ignored, whatever
    their names.

    The documents of a bucket are first compared with its smallest id. Only pairs of a bucket that
    are in different components then are compared as well, block against block inside tasks, by
    sketch and then exactly, and of those only links leave the task: every link that matters is
    found without the pairs of a group being written out.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    p = threshold + (1 - threshold) / 256
    k = rows * n_bands
    least = int(np.floor(k * p - SLACK * np.sqrt(k * p * (1 - p))))

    signed = stored(texts.mapInArrow(_sign(shingle, rows, n_bands), f"id {kind}, content binary, bands array<long>, sketch binary"), "signatures")
    usable = signed.where("id is not null and content is not null")
    copies = stored(usable.groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "copies")
    nodes = usable.join(copies.select("content", F.col("rep").alias("id")), ["content", "id"], "left_semi")

    placed = nodes.select("id", F.posexplode("bands").alias("band", "bucket"))
    buckets = stored(placed.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(join_spread(placed, buckets, "bucket", "n", ["center", "n"], F.col("id")).where("center is not null"), "members")
    sketches = stored(nodes.select("id", "sketch", "bands").join(members.select("id"), "id", "left_semi"), "sketches")

    stars = stored(members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    sketched = _with_end(stars, sketches, "a", "sketch").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    near = stored(sketched.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agree(least), f"a {kind}, b {kind}"), "near-pairs")
    links = stored(_checked(near, texts, shingle, threshold), "links")
    reached = stored(components(links), "components")

    label = F.coalesce("component", "id")
    labelled = stored(members.join(reached, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", label.alias("label"), "n"), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    open_ = stored(labelled.join(mixed, "bucket", "left_semi"), "open-buckets")
    open_ = open_.join(sketches, "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    grouped = open_.select(F.xxhash64("bucket", low, high).alias("group"), "own", (low != high).alias("across"), "band", F.xxhash64("label").alias("label"), "id", "sketch", "bands")
    # sketches meet first; only rows that are near another bring their whole set
    near = stored(grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_candidates(least), f"group long, id {kind}"), "candidates")
    sets = stored(texts.join(near.select("id"), "id", "left_semi").mapInArrow(_units(shingle), f"id {kind}, units binary"), "units")
    whole = grouped.join(near, ["group", "id"], "left_semi").join(sets, "id")
    more = stored(whole.repartition("group").sortWithinPartitions("group").mapInArrow(_open_links(least, threshold), f"a {kind}, b {kind}"), "more-links")

    # links between components join them
    named = more.join(reached.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(reached.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    found = join_spread(usable.select("id", "content"), copies, "content", "copies", ["rep"], F.col("id"))
    found = found.join(reached, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("first"))
    found = found.join(merged, F.col("first") == F.col("node"), "left").select("id", F.coalesce("component", "first").alias("component_id"))
    return _finish(docs, found, id_col)


def _with_end(pairs: DataFrame, table: DataFrame, end: str, column: str) -> DataFrame:
    """Add ``column`` of the document at ``end``; a document in many pairs is spread."""
    many = pairs.groupBy(end).agg(F.count("*").alias("n"))
    looked = stored(table.withColumnRenamed("id", end).join(many, end).select(end, "n", F.col(column).alias(f"{column}_{end}")), "looked-up")
    return join_spread(pairs, looked, end, "n", [f"{column}_{end}"], F.xxhash64("a", "b"))


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The stored pairs (a, b) whose texts are similar; only their texts are fetched."""
    kind = pairs.schema["a"].dataType.simpleString()
    ends = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ends")
    held = stored(texts.join(ends, "id", "left_semi"), "pair-texts")
    both = _with_end(pairs, held, "a", "text").join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(shingle, threshold), f"a {kind}, b {kind}")


def _finish(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    # rows that repeat an id share its smallest component
    found = stored(found.groupBy("id").agg(F.min("component_id").alias("component_id")), "found")
    sizes = found.groupBy("component_id").agg(F.count("*").alias("group_size"))
    sized = join_spread(found, stored(sizes, "sizes"), "component_id", "group_size", ["group_size"], F.col("id"))
    ids = docs.select(F.col(id_col))
    out = ids.join(sized.withColumnRenamed("id", id_col), id_col, "left")
    return out.select(
        id_col,
        F.coalesce("component_id", F.col(id_col)).alias("component_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)).alias("kept"),
    )
