"""Near-duplicate documents by MinHash with odd sketches.

A document's set holds its distinct word shingles. Documents with equal sets form a class;
the classes' MinHash samples give band keys, and two odd sketches: bitmaps in which each
sample flips one bit, so that the XOR of two has few bits for similar sets. One folds the
bands' samples; the other folds the samples of a permutation with a bin for every shingle,
so its XOR never has more bits than the sets have different shingles. Classes that share a
band key are candidates; pairs whose sketches differ too much fall away, the others are
confirmed on their full sets.

Within a key every class is compared with the key's hub, the class that shares keys with
most others (of near copies, the text they were made from). Components of the links so found
are formed, and only keys that still hold several components are compared further, in blocks
of classes of different components; so no link that a key can show is lost, and a key with
many alike documents costs in proportion to its rows.

Defined results: null texts and texts without words have an empty set and link with nothing;
words are lower-cased in A-Z only; repeated rows are one class; a null id never names a
component that has other ids. With 32 bands of 4 samples a pair of similarity 0.85 shares no
key with probability 6e-11, one of 0.80 with 5e-8; a similar pair has sketches apart by more
than most_bits with probability under 1e-9. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import textscan
from loomline.llm.common import stored, text_key, text_of, whole_row
from loomline.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
BITS = 64 * SKETCH_WORDS
SET_WORDS = 16
SET_BITS = 64 * SET_WORDS
#: The chance that a pair of just the threshold's similarity has sketches further apart than most_bits.
LOST = 1e-9
#: Percent of the union that the intersection must have.
LEAST = 85
#: The least threshold that the bands are chosen for.
LOWEST = 80
BLOCK = 256
#: What a text with words holds.
WORD = "[^\\x20\\x09-\\x0D]"
#: Texts of fewer words are known by both families of word hashes.
FEW = 64

_FLIP = textscan.draws(SAMPLES, 11).astype(np.uint32)
_TIMES = textscan.draws(SAMPLES, 12).astype(np.uint32) | np.uint32(1)
_PLACE = textscan.draws(SAMPLES, 13)
_STEP = textscan.draws(SHINGLE, 14) | np.uint64(1)
_BAND = textscan.draws(SAMPLES, 15) | np.uint64(1)
_BAND_NO = textscan.draws(BANDS, 16)


def text_words(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number and folded word hashes (a row for each family) of each text that has words."""
    row, held = -1, []
    for words in textscan.word_blocks(data, at):
        if not len(words.starts):
            continue
        hashes = np.stack(words.hashes(folded=True))
        edges = np.flatnonzero(np.diff(words.rows)) + 1
        for number, part in zip(words.rows[np.concatenate([[0], edges])].tolist(), np.split(hashes, edges, axis=1), strict=True):
            if number != row and held:
                yield row, np.concatenate(held, axis=1) if len(held) > 1 else held[0]
                held = []
            row = number
            held.append(part)
    if held:
        yield row, np.concatenate(held, axis=1) if len(held) > 1 else held[0]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words, or of the whole if shorter."""
    n = len(words)
    if n < SHINGLE:
        return textscan.mix((words * _STEP[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[: n - SHINGLE + 1] * _STEP[0]
    for k in range(1, SHINGLE):
        total += words[k : n - SHINGLE + 1 + k] * _STEP[k]
    return np.unique(textscan.mix(total))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima, each under its own permutation of 32-bit values."""
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 2048):
        np.minimum(low, ((short[k : k + 2048, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return low


def sketch_rows(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text with words: its number, set size, class, band keys, and sketch."""
    data, at = textscan.buffers(texts)
    numbers, sizes, classes, samples, parity = [], [], [], [], []
    for number, words in text_words(data, at):
        own = shingle_set(words[0])
        numbers.append(number)
        sizes.append(len(own))
        classes.append(class_of(own, words))
        samples.append(minhash(own))
        parity.append(np.bincount((own & np.uint64(SET_BITS - 1)).astype(np.int64), minlength=SET_BITS).astype(np.uint8) & 1)
    drawn = np.array(samples, np.uint64).reshape(-1, SAMPLES)
    keys = (textscan.mix(drawn) * _BAND).reshape(-1, BANDS, ROWS).sum(axis=2) + _BAND_NO
    places = (textscan.mix(drawn + _PLACE) % np.uint64(BITS)).astype(np.int64) + np.arange(len(drawn))[:, None] * BITS
    odd = np.bincount(places.ravel(), minlength=len(drawn) * BITS).astype(np.uint8) & 1
    both = np.concatenate([odd.reshape(-1, BITS), np.array(parity, np.uint8).reshape(-1, SET_BITS)], axis=1)
    sketch = np.packbits(both, axis=1).view(np.int64) if len(drawn) else np.zeros((0, SKETCH_WORDS + SET_WORDS), np.int64)
    return {"number": np.array(numbers, np.int64), "n_shingles": np.array(sizes, np.int64), "cls": classes, "keys": textscan.mix(keys).view(np.int64), "sketch": sketch}


def class_of(shingles: np.ndarray, words: np.ndarray) -> bytes:
    """128 bits that stand for the set, in which few shingles may be all that differ: then
    half of them come from the second family of word hashes."""
    one = textscan.mix(shingles + np.uint64(len(shingles))).sum()
    if words.shape[1] < FEW:
        two = shingle_set(words[1]).sum()
    else:
        two = textscan.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    return one.tobytes() + textscan.mix(two[None]).tobytes()


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, th (the text's key), n_shingles, cls (null: empty set), keys, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            rows, n = sketch_rows(batch.column(2)), batch.num_rows
            place = np.full(n, len(rows["number"]), np.int64)
            place[rows["number"]] = np.arange(len(rows["number"]))
            pick = pa.array(np.where(place < len(rows["number"]), place, 0), mask=place >= len(rows["number"]))
            sizes = np.append(rows["n_shingles"], 0)[place]
            columns = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(rows["cls"], pa.binary()).take(pick), _lists(rows["keys"]).take(pick), _lists(rows["sketch"]).take(pick)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "th", "n_shingles", "cls", "keys", "sketch"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, th binary, n_shingles long, cls binary, keys array<long>, sketch array<long>"
    return docs.select(id_col, text_key(text).alias("th"), text).mapInArrow(run, schema)


def _apart(a: Column, b: Column, words: range) -> Column:
    """Bits in which two sketches differ in the given words."""
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in words]
    return sum(bits[1:], bits[0])


@lru_cache
def most_bits(least: int = LEAST) -> int:
    """Bits that the samples' sketches of a similar pair may differ in: of SAMPLES samples each
    differs with probability 1 - similarity and then flips two bits."""
    differs, k = 1 - least / 100, np.arange(BITS + 1)
    at = np.zeros(BITS + 1)
    at[0] = 1

    def flipped(at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        out[1:] += at[:-1] * (1 - k[:-1] / BITS)
        out[:-1] += at[1:] * k[1:] / BITS
        return out

    for _ in range(SAMPLES):
        at = (1 - differs) * at + differs * flipped(flipped(at))
    return int(np.flatnonzero(np.cumsum(at[::-1])[::-1] < LOST)[0]) - 1


def most_set_bits(sizes: np.ndarray | Column, exp, least: int = LEAST):  # noqa: ANN001, ANN201
    """Bits that the set sketches of a similar pair may differ in, from the sum of its sizes:
    where few flips meet, their number bounds the bits; where many do, the bits' mean plus
    six deviations."""
    flips = sizes * ((100 - least) / (100 + least))
    mean = (1 - exp(flips * (-2 / SET_BITS))) * (SET_BITS / 2)
    return flips, mean + 6 * (SET_BITS**0.5 / 2)


def _close(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Those of the pairs a, b whose sketches are close."""
    of = lambda c: classes.select(F.col("cls").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    x, y = F.col("sa"), F.col("sb")
    bound, likely = most_set_bits((F.col("na") + F.col("nb")).cast("double"), F.exp, least)
    near = (_apart(x, y, range(SKETCH_WORDS)) <= most_bits(least)) & (_apart(x, y, range(SKETCH_WORDS, SKETCH_WORDS + SET_WORDS)) <= F.least(bound, likely) + 1e-6)
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(near).select("a", "b")


def class_sets(texts: DataFrame) -> DataFrame:
    """cls and the set, as packed 64-bit values, of each row's text; a row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            data, at = textscan.buffers(batch.column(0))
            sets = [(shingle_set(words[0]), words) for _, words in text_words(data, at)]
            yield pa.RecordBatch.from_arrays([pa.array((class_of(s, w) for s, w in sets), pa.binary()), pa.array((s.tobytes() for s, _ in sets), pa.binary())], ["cls", "shingles"])

    return texts.select("text").mapInArrow(run, "cls binary, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Those of the pairs a, b with 100 * intersection >= least * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                place = np.minimum(np.searchsorted(one, two), len(one) - 1)
                same = int((one[place] == two).sum())
                ok[i] = 100 * same >= least * (len(one) + len(two) - same)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    of = lambda c: sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"x{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a binary, b binary")


def _crossing(members: DataFrame, least: int) -> DataFrame:
    """members: key, cls, root, sketch, n_shingles, n (rows of the key). Close pairs a, b of one key and
    different roots: the key's rows are dealt to blocks, and each pair of blocks is one group."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    dealt = dealt.select("key", "cls", "root", "sketch", "n_shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "root", "sketch", "n_shingles")

    close, width = most_bits(least), SKETCH_WORDS + SET_WORDS

    def pairs_of(block: np.ndarray, lo: int, hi: int, sketch: np.ndarray, sizes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in one.tolist():
            others = two if lo != hi else two[two > i]
            others = others[root[others] != root[i]]
            bits = np.bitwise_count(sketch[others] ^ sketch[i])
            most = np.minimum(*most_set_bits(sizes[others] + sizes[i], np.exp, least)) + 1e-6
            found = others[(bits[:, :SKETCH_WORDS].sum(axis=1) <= close) & (bits[:, SKETCH_WORDS:].sum(axis=1) <= most)]
            a.append(np.full(len(found), i))
            b.append(found)
        return np.concatenate(a), np.concatenate(b)

    def groups(table: pa.Table) -> pa.RecordBatch:
        """The pairs of whole groups, which stand one after the other."""
        key, lo, hi, block, sizes = (table[c].to_numpy() for c in ("key", "lo", "hi", "block", "n_shingles"))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, width).view(np.uint64)
        root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1, [len(key)]]).tolist()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j - i > 1:
                x, y = pairs_of(block[i:j], lo[i], hi[i], sketch[i:j], sizes[i:j].astype(float), root[i:j])
                a.append(x + i)
                b.append(y + i)
        cls = table["cls"].combine_chunks()
        return pa.RecordBatch.from_arrays([cls.take(pa.array(np.concatenate(x))) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of group; the last group of a batch waits for the next."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            last = [table[c].to_numpy() for c in ("key", "lo", "hi")]
            start = int(np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in last]))[-1]) + 1 if any((x != x[-1]).any() for x in last) else 0
            if start:
                yield groups(table.slice(0, start))
            held = table.slice(start)
        if held is not None and held.num_rows:
            yield groups(held)

    ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = ordered.mapInArrow(run, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, drawn: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Components of the classes of drawn (sketches of docs): node, root, for linked classes."""
    classes = stored(drawn.filter("cls is not null").select("cls", "th", "n_shingles", "keys", "sketch").dropDuplicates(["cls"]), "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "cls")
    # keys of one class only, most of them, show no pair
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keyed.join(groups, "key"), "members")
    shared = members.groupBy("cls").agg(F.sum("n").alias("shared"))
    hubs = members.join(shared, "cls").groupBy("key").agg(F.max(F.struct("shared", "cls"))["cls"].alias("a"))
    star = members.join(hubs, "key").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    pairs = stored(_close(star, classes, least), "pairs")

    texts = docs.select(text_key(text).alias("th"), text_of(text).alias("text")).groupBy("th").agg(F.first("text").alias("text"))
    wanted = members.select("cls").distinct().join(classes.select("cls", "th"), "cls").select("th").distinct()
    sets = stored(class_sets(texts.join(wanted, "th", "left_semi")).dropDuplicates(["cls"]), "sets")

    first = stored(confirm(pairs, sets, least), "links")
    roots = components(first)
    named = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    open_ = named.join(mixed, "key").join(classes.select("cls", "sketch", "n_shingles"), "cls").select("key", "cls", "root", "sketch", "n_shingles", "n")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = stored(_crossing(open_, least).join(tried, ["a", "b"], "left_anti"), "crossing")
    if crossing.isEmpty():
        return roots
    second = stored(confirm(crossing, sets, least), "links")
    if second.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """id_col, th, n_shingles, component_id (the least id that the document reaches), kept
    (whether that is its own) and root (the component's own class, whatever its ids; null:
    empty set), a row per document. A threshold for which the bands would lose links is refused."""
    if not LOWEST <= least <= 100:
        raise ValueError(f"least must be from {LOWEST} to 100: the bands lose links below that")
    drawn = stored(sketches(docs, id_col, text), "sketches")
    roots = links(docs, drawn, text, least)
    own = drawn.filter("cls is not null").groupBy("cls").agg(F.min(id_col).alias("low"))
    named = own.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    linked = named.filter("root is not null")
    # written, so that a join with a component of many classes can be split
    lowest = stored(linked.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    alone = named.filter("root is null").select("cls", F.col("cls").alias("root"), F.col("low").alias("component_id"))
    label = linked.join(lowest, "root").select("cls", "root", "component_id").union(alone)
    out = drawn.select(id_col, "th", "n_shingles", "cls").join(label, "cls", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", id_col))
    return out.select(id_col, "th", "n_shingles", "component_id", F.equal_null(F.col(id_col), F.col("component_id")).alias("kept"), "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with one row of each component, whether or not others share its id (the least id;
    of repeated ids the least text key); rows without words all stay."""
    marked = near_duplicates(docs, id_col, text, least).filter("kept and n_shingles > 0")
    chosen = marked.groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("id_"), F.col("th").alias("th_"))).alias("least")).select("least.*")
    chosen = stored(chosen.withColumnRenamed("id_", "low").withColumnRenamed("th_", "key"), "chosen")
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), text_key(text).alias("th"), text_of(text).rlike(WORD).alias("has"))
    match = F.equal_null("id", "low") & (F.col("th") == F.col("key"))
    one = rows.filter("has").join(chosen, match, "left_semi").dropDuplicates(["id", "th"])
    return one.select("row.*").union(rows.filter("not has").select("row.*"))
