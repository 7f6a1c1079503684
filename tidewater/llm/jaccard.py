"""N-gram Jaccard join: a grouped prefix join over word shingles, and its connected components.

A document's set are its distinct shingles of five lower-cased words, as 64-bit hashes. Documents
with equal sets form a class, known by a 128-bit fingerprint. Of each class's set the first shingles in
one global order are its prefix: the shingles that are frequent over all documents come last, the rest
by their hashes. The prefix is a little longer than one common shingle asks for, so that two sets that
are similar enough share SHARED shingles of their prefixes, whatever the order is; no link is lost.

Classes with one size and prefix collapse into a group, and groups are what is joined:

1. Every prefix shingle is a bucket of groups. Buckets of one group are dropped. In each other bucket
   every group meets the PIVOTS first groups; the group pairs are filtered by size.
2. What is left is expanded: the pairs' representatives, and every group's members with theirs, are
   bounded by parity maps (a bit or two a shingle) and verified by their whole sets, the likeliest pair
   of each class first and none whose ends are linked by then.
3. Buckets in which not all classes have met, and whose classes are still in different components, are
   expanded to members. What similar sets must share lies then in such buckets alone, so each class leaves
   the largest SHARED - 1 of its own. Those outside the bucket's largest component are held against each other and
   against it, in cells of two blocks of bounded size. A cell first names the members for whose parity
   maps some partner is possible; their sets then meet in the cell, which counts all intersections
   exactly and returns only links that join two of its components: fewer than its members.

Every pair that could link is thus compared, or already joined, so the components are exact. A group's
id has 64 bits: two groups with one id are one larger group, which changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewater.llm.shared import BLOOM_WORDS, components, cut, in_bloom, pack, unused
from tidewater.llm.text import U64, column_bytes, mix, shingle_hashes, slices, word_hashes

#: At most so many shingles count as frequent: their list is 48 MB at most.
FREQUENT = 1 << 22
#: Shingles gathered by a task before it counts the repeated ones.
GATHER = 1 << 20
#: Prefix shingles that similar sets must share.
SHARED = 4
#: Shingles counted so often go to SALTS tasks each.
HOT, SALTS = 4096, 64
#: Groups of a bucket that all others meet.
PIVOTS = 16
#: Classes, and shingles of them, in a block of a cell.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles whose bits are held at once.
COLUMNS = 1 << 15


def _sets(batches, text: str):
    """(batch part, sets of its rows) of batches whose second column is the text."""
    for whole in batches:
        for part in slices(whole, text, 1 << 20):
            data, offsets = column_bytes(part.column(1))
            words, at = word_hashes(data, offsets)
            yield part, [shingle_hashes(words[at[i] : at[i + 1]]) for i in range(part.num_rows)]


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums a set that do not depend on the order of its shingles."""
    out = np.empty((len(sets), 2), U64)
    for i, s in enumerate(sets):
        out[i, 0] = mix(mix(s).sum(dtype=U64)[None] + U64(len(s)))[0]
        out[i, 1] = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return out


def _ids(prints: np.ndarray) -> pa.Array:
    """Fingerprints as an Arrow column of 16 bytes each."""
    return pa.Array.from_buffers(pa.binary(16), len(prints), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())


def _prints(ids: pa.Array) -> np.ndarray:
    """The fingerprints of such a column without nulls."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    fixed = ids.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], U64)[2 * fixed.offset : 2 * (fixed.offset + len(fixed))].reshape(-1, 2) if len(fixed) else np.empty((0, 2), U64)


def _prefix(s: np.ndarray, similarity: int, frequent: np.ndarray, counts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a sorted set in the global order, as many as the similarity asks for, and how often each was counted."""
    n = len(s)
    least = -(-similarity * n // 100)
    take = n - least + min(SHARED, least)
    hit = np.flatnonzero(mask[(s & U64(len(mask) - 1)).astype(np.int64)])
    if len(hit):
        spot = np.minimum(np.searchsorted(frequent, s[hit]), len(frequent) - 1)
        real = frequent[spot] == s[hit]
        hit, spot = hit[real], spot[real]
    if not len(hit):
        return s[:take], np.zeros(take, np.int32)
    rest = np.delete(s, hit)
    if len(rest) >= take:
        return rest[:take], np.zeros(take, np.int32)
    last = np.lexsort((s[hit], counts[spot]))[: take - len(rest)]
    return np.concatenate((rest, s[hit[last]])), np.concatenate((np.zeros(len(rest), np.int32), counts[spot[last]]))


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of a key in filters made by ``_filter``."""
    k = key.astype(np.int64, copy=False).view(U64)
    return mix(k).view(np.int64), mix(k ^ U64(0xA5A5A5A5A5A5A5A5)).view(np.int64)


def _wanted(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    return in_bloom(words, *_bits(key))


#: Words of Bloom filters, as ``_key_bits`` gives them.
_KEY_BITS = "f int, w long, b long"


def _key_bits(of: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """The filter words, and bits in them, of the keys of some filters."""
    found = np.concatenate(_bits(key)).view(U64)
    bit = (U64(1) << (found >> U64(58))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.tile(of, 2).astype(np.int32)), pa.array((found & U64(BLOOM_WORDS - 1)).astype(np.int64)), pa.array(bit)], names=["f", "w", "b"])


def _gathered(bits: DataFrame, filters: int = 1) -> list[np.ndarray]:
    """Bloom filters of fixed size, from their bits."""
    rows = bits.groupBy("f", "w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    words = np.zeros((filters, BLOOM_WORDS), np.int64)
    words[rows.column("f").to_numpy(), rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return list(words.view(U64))


def _filters(keys: DataFrame, filters: int = 1) -> list[np.ndarray]:
    """Bloom filters from rows of (filter's number, class id, or else a long), in the hashes of ``_bits``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1).is_valid()
            yield _key_bits(batch.column(0).filter(ids).to_numpy(), _half(_prints(batch.column(1).drop_null())))
            longs = pa.compute.invert(ids)
            yield _key_bits(batch.column(0).filter(longs).to_numpy(), batch.column(2).filter(longs).to_numpy())

    return _gathered(keys.mapInArrow(run, _KEY_BITS), filters)


def _half(prints: np.ndarray) -> np.ndarray:
    """The first halves of fingerprints, which filters take."""
    return np.ascontiguousarray(prints[:, 0]).view(np.int64)


def _pair_key(prints: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(prints[:, 0] * U64(0x9E3779B97F4A7C15) + doc.astype(np.int64).view(U64)).view(np.int64)


def _parity(s: np.ndarray) -> bytes:
    """A bit for each residue of the shingles' hashes, on if an odd number of them has it; a bit a shingle or so."""
    size = 1 << min(17, max(6, (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _differences(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many shingles are in one of two sets only: a larger map is folded to the smaller one's size."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def near_duplicates(documents: DataFrame, text: str = "text", similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Documents link when 100 * intersection >= similarity * union of their sets. Null, empty and blank
    texts have an empty set and link with nothing, equal ones neither; a null doc_id is not counted as
    a component's smallest id. Repeated rows give repeated results. Long texts are worked on whole.
    Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    return _by_row(*_classes(documents, text, similarity))


def _by_row(rows: DataFrame, of: DataFrame) -> DataFrame:
    out = rows.join(of, F.col("cid") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(documents: DataFrame, text: str, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, n, cid), and every class's (c, component, component_id): its id, and where it belongs."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n", "cid", "shingle", "parity"]

    def first_pass(batches):
        gathered, n = [], 0

        def repeated():
            found, counts = np.unique(np.concatenate(gathered), return_counts=True)
            keep = counts >= 2
            size = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(counts[keep].astype(np.int64)), pa.nulls(size, pa.binary()), pa.array(found[keep].view(np.int64)), pa.nulls(size, pa.binary())], names=names)

        for part, sets in _sets(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _ids(_fingerprints(sets)), pa.nulls(len(sets), pa.int64()), pa.array([_parity(s) for s in sets], pa.binary())], names=names)
            gathered += sets
            n += sum(map(len, sets))
            if n >= GATHER:
                yield repeated()
                gathered, n = [], 0
        if gathered:
            yield repeated()

    seen = cut(docs.mapInArrow(first_pass, "doc_id long, n long, cid binary, shingle long, parity binary"))
    rows = seen.where("shingle is null").select("doc_id", "n", "cid")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(12, total // FREQUENT)
    counted = seen.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    frequent = counted.column("shingle").to_numpy().view(U64)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], np.minimum(counted.column("n").to_numpy()[order], 2**31 - 1).astype(np.int32)
    mask = np.zeros(1 << 20, bool)
    mask[(frequent & U64(len(mask) - 1)).astype(np.int64)] = True
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("num", F.monotonically_increasing_id()))
    parity = seen.where("shingle is null and n > 0").select("cid", "n", "parity")

    # Only one copy of a class has to give its set. A class that the first filter takes for a copied one is in
    # the second by its own row, so that false positives let others through and keep none out.
    copied_words = _filters(classes.where("copies > 1 and first_doc is not null").select(F.lit(0), "cid", F.lit(None).cast("long")))[0]
    copied = spark.sparkContext.broadcast(copied_words)

    def taken_for_copied(batches):
        for batch in batches:
            prints, doc = _prints(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            hit = _wanted(_half(prints), copied.value)
            yield _key_bits(np.zeros(int(hit.sum()), np.int32), _pair_key(prints[hit], doc[hit]))

    first_words = _gathered(classes.where("first_doc is not null").select("cid", "first_doc").mapInArrow(taken_for_copied, _KEY_BITS))[0]
    shared = spark.sparkContext.broadcast((frequent, counts, mask, copied_words, first_words))

    def giving(part, sets) -> tuple[np.ndarray, np.ndarray]:
        """The rows that give their prefixes, and all fingerprints."""
        prints = _fingerprints(sets)
        doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        copied_w, first_w = shared.value[3:]
        known = ~part.column(0).is_null().to_numpy(zero_copy_only=False)
        one = np.array([len(s) > 0 for s in sets], bool)
        once = ~_wanted(_half(prints), copied_w)
        return np.flatnonzero(one & (~known | once | _wanted(_pair_key(prints, doc), first_w))), prints

    def second_pass(batches):
        frequent, counts, mask = shared.value[:3]
        for part, sets in _sets(batches, "text"):
            at, prints = giving(part, sets)
            shingles, salts, lengths = [], [], []
            groups, sizes = np.empty(len(at), U64), np.empty(len(at), np.int32)
            for k, i in enumerate(at):
                prefix, often = _prefix(sets[i], similarity, frequent, counts, mask)
                groups[k] = mix(mix(prefix ^ U64(7)).sum(dtype=U64)[None] + U64(len(sets[i])))[0]
                sizes[k] = len(sets[i])
                shingles.append(prefix)
                salts.append(np.where(often >= HOT, np.int32(1 + int(groups[k]) % SALTS), np.int32(0)))
                lengths.append(len(prefix))
            if len(at):
                entries = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.repeat(groups, lengths).view(np.int64)), pa.nulls(sum(lengths), pa.binary()), pa.array(np.repeat(sizes, lengths))],
                    names=["h", "salt", "gid", "cid", "n"],
                )
                yield entries
                yield pa.RecordBatch.from_arrays([pa.array(_half(prints[at])), pa.array(np.full(len(at), -1, np.int32)), pa.array(groups.view(np.int64)), _ids(prints[at]), pa.array(sizes)], names=entries.schema.names)

    prefixes = docs.mapInArrow(second_pass, "h long, salt int, gid long, cid binary, n int")
    both = cut(prefixes.repartition("h", "salt").sortWithinPartitions("h", "salt", "gid", "n").mapInArrow(_shared_only, prefixes.schema))
    entries = both.where("salt >= 0").select("h", "gid", "n")
    members = both.where("salt < 0").select("gid", "cid", "n").dropDuplicates(["cid"])
    members = cut(members.join(classes.select("cid", "num"), "cid").select("gid", "num", "n"))

    def parity_of(wanted):
        """(num, n, parity) of the classes in a one-column table."""
        ids = classes.join(wanted, "num", "left_semi").select("cid", "num")
        return cut(parity.join(ids, "cid").drop("cid").dropDuplicates(["num"]))

    def sets_of(wanted):
        """(num, shingles) of the classes in a one-column table, read from their first documents' texts once more."""
        ids = pack(classes.join(wanted, "num", "left_semi").select("cid", "num", "first_doc"))
        keys = ids.select(F.lit(0), F.lit(None).cast("binary"), "first_doc").where("first_doc is not null").union(ids.select(F.lit(1), "cid", F.lit(None).cast("long")))
        words = spark.sparkContext.broadcast(_filters(keys, 2))

        def third_pass(batches):
            doc_w, class_w = words.value

            def first_documents():
                for batch in batches:
                    doc = batch.column(0)
                    maybe = _wanted(doc.fill_null(0).to_numpy(zero_copy_only=False), doc_w) | doc.is_null().to_numpy(zero_copy_only=False)
                    if maybe.any():
                        yield batch.filter(pa.array(maybe))

            for _, sets in _sets(first_documents(), "text"):
                prints = _fingerprints(sets)
                at = np.flatnonzero(_wanted(_half(prints), class_w) & np.array([len(s) > 0 for s in sets], bool))
                if len(at):
                    yield pa.RecordBatch.from_arrays([_ids(prints[at]), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["cid", "shingles"])

        found = docs.mapInArrow(third_pass, "cid binary, shingles binary").join(ids.select("cid", "num"), "cid")
        return cut(found.drop("cid").dropDuplicates(["num"]))

    joined = _joined(entries, members, parity_of, sets_of, similarity)
    of = classes.join(joined.withColumnRenamed("id", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    named = of.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of = of.join(named, "component").select(F.col("cid").alias("c"), "component", "component_id")
    return rows, of


def _shared_only(batches):
    """Of rows sorted by (h, salt, gid, n), those whose h has another group, each once; salted rows all.

    One row is held back until its successor is known.
    """
    held, matched = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h, s, g, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1]) | (s[1:] < 0)
        batch = batch.filter(pa.array(fresh))
        h, s = h[fresh], s[fresh]
        keep = s != 0
        alike = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        keep[1:] |= alike
        keep[:-1] |= alike
        keep[0] |= matched
        held, matched = batch.slice(len(h) - 1), bool(keep[-1])
        keep[-1] = False
        yield batch.filter(pa.array(keep))
    if held is not None and matched:
        yield held


def _joined(entries: DataFrame, members: DataFrame, parity_of, sets_of, similarity: int) -> DataFrame:
    """(id, component) of the classes that link with others."""
    fits = f"100L * least(n, m) >= {similarity}L * greatest(n, m)"
    groups = cut(members.groupBy("gid").agg(F.min("num").alias("rep"), F.count("*").alias("members")))
    first = groups.select("gid", "rep")

    # group pairs: every group of a bucket and the bucket's pivots
    pivots = entries.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy(F.xxhash64("gid"), "gid", "n"))).where(F.col("r") <= PIVOTS)
    pivots = pivots.select(F.col("h").alias("ph"), F.col("gid").alias("pivot"), F.col("n").alias("m"))
    later = F.expr("struct(xxhash64(pivot) AS x, pivot AS y, m AS z) < struct(xxhash64(gid) AS x, gid AS y, n AS z)")
    pairs = entries.join(pivots, (F.col("h") == F.col("ph")) & later).where(fits).where("gid <> pivot")
    pairs = pack(pairs.select(F.least("gid", "pivot").alias("x"), F.greatest("gid", "pivot").alias("y")).distinct())

    # expanded: the representatives of group pairs, and members with their group's
    across = pairs.join(first.select(F.col("gid").alias("x"), F.col("rep").alias("a")), "x").join(first.select(F.col("gid").alias("y"), F.col("rep").alias("b")), "y")
    several = members.join(groups.where("members > 1").select("gid", "rep"), "gid").where("num <> rep")
    pairs = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(several.select(F.col("rep").alias("a"), F.col("num").alias("b")))
    possible = pack(_bounded(pairs.distinct(), parity_of, similarity))
    sets = sets_of(possible.select(F.explode(F.array("a", "b")).alias("num")).distinct())
    # the likeliest pair of every class first, then what is still apart
    best = possible.select(F.explode(F.array("a", "b")).alias("end"), "d", "a", "b").groupBy("end").agg(F.min(F.struct("d", "a", "b")).alias("pair"))
    best = pack(best.select("pair.a", "pair.b").distinct())
    label = components(_verify(best, sets, similarity))
    apart = pack(_apart(possible.select("a", "b").join(best, ["a", "b"], "left_anti"), label))
    label = components(_edges(label).union(_verify(apart, sets, similarity)))

    more = _within_buckets(entries, members, groups, label, parity_of, sets_of, similarity)
    return label if more is None else components(_edges(label).union(more))


def _edges(label: DataFrame) -> DataFrame:
    return label.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _within_buckets(entries: DataFrame, members: DataFrame, groups: DataFrame, label: DataFrame, parity_of, sets_of, similarity: int) -> DataFrame | None:
    """Links (a, b) that join components among the classes of buckets in which not all have met; None if no pair is possible.

    A bucket is known by (kind, h): a prefix shingle, or a group of three members or more.
    """
    several = groups.where("members > 1").select("gid", "members")
    sizes = entries.join(several, "gid", "left").groupBy("h").agg(F.count("*").alias("g"), F.sum(F.coalesce("members", F.lit(1))).alias("c"))
    open_ = sizes.where((F.col("g") > PIVOTS + 1) | (F.col("c") > F.col("g"))).select("h")
    rows = entries.join(open_, "h", "left_semi").select("h", "gid").join(members, "gid").select(F.lit(0).alias("kind"), "h", "num", "n")
    own = members.join(groups.where("members > 2").select("gid"), "gid", "left_semi").select(F.lit(1).alias("kind"), F.col("gid").alias("h"), "num", "n")
    rows = rows.union(own).join(label, F.col("num") == F.col("id"), "left")
    rows = pack(rows.select("kind", "h", "num", "n", F.coalesce("component", "num").alias("component")))

    # Classes of different components that have not met share SHARED such buckets, or as many as the smaller set
    # asks for. So each may leave that many less one of its buckets, the largest ones, and some bucket stays common.
    mixed = rows.groupBy("kind", "h").agg(F.count("*").alias("all"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")
    rows = rows.join(mixed, ["kind", "h"])
    place = F.row_number().over(W.partitionBy("kind", "num").orderBy(F.col("all").desc(), "h"))
    may = F.least(F.lit(SHARED), F.ceil(F.col("n") * similarity / 100)) - 1
    rows = held = pack(rows.withColumn("place", place).where((F.col("kind") == 1) | (F.col("place") > may)).drop("place", "all"))

    # a bucket's largest component against the rest, and the rest against itself; a small bucket is one cell
    each = rows.groupBy("kind", "h", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    top = each.groupBy("kind", "h").agg(F.max(F.struct("c", "component", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    top = top.select("kind", "h", F.col("top.component").alias("main"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("rest_blocks"), blocks(F.col("top.c"), F.col("top.w")).alias("main_blocks"), (blocks(F.col("c"), F.col("w")) == 1).alias("one"))
    rows = rows.join(top, ["kind", "h"]).withColumn("rest", F.col("component") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("num"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda t, i, j, left: F.struct(F.lit(t).alias("t"), i.alias("i"), j.alias("j"), left.alias("left"))
    own_ = F.col("own")
    of_rest = F.concat(
        F.transform(upto(F.col("rest_blocks")), lambda k: cell(0, F.least(own_, k), F.greatest(own_, k), own_ <= k)),
        F.transform(upto(F.col("main_blocks")), lambda k: cell(1, own_, k, F.lit(True))),
    )
    of_main = F.transform(upto(F.col("rest_blocks")), lambda k: cell(1, k, own_, F.lit(False)))
    cells = rows.withColumn("cell", F.explode(F.when(F.col("one"), F.array(cell(0, F.lit(0), F.lit(0), F.lit(True)))).when(F.col("rest"), of_rest).otherwise(of_main))).select("kind", "h", "cell.*", "num", "n", "component")
    key = ["kind", "h", "t", "i", "j"]

    maps = parity_of(held.select("num").distinct()).select("num", "parity")
    bounded = cells.join(maps, "num").select(*cells.columns, "parity").repartition(*key).sortWithinPartitions(*key)
    likely = pack(bounded.mapInArrow(_cells(lambda rows: _likely(rows, similarity)), cells.schema))
    if likely.isEmpty():
        return None
    whole = likely.join(sets_of(likely.select("num").distinct()), "num").select(*cells.columns, "shingles").repartition(*key).sortWithinPartitions(*key)
    return whole.mapInArrow(_cells(lambda rows: _cell_links(rows, similarity)), "a long, b long")


def _cells(work):
    """Streams rows sorted by cell: what ``work`` makes of the table of each."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            change = np.zeros(rest.num_rows - 1, bool)
            for k in range(5):
                x = rest.column(k).to_numpy()
                change |= x[1:] != x[:-1]
            ends = np.flatnonzero(change) + 1
            for a, b in zip([0, *ends], ends):
                yield from work(rest.slice(a, b - a)).to_batches()
            if len(ends):
                rest = rest.slice(ends[-1])
        if rest is not None:
            yield from work(rest).to_batches()

    return run


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of both sides of a cell (one side of a block with itself is all of it), all rows' sizes and components."""
    left = rows.column("left").to_numpy()
    if rows.column("t")[0].as_py() == 0 and rows.column("i")[0].as_py() == rows.column("j")[0].as_py():
        one = two = np.arange(rows.num_rows)
    else:
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
    return one, two, rows.column("n").to_numpy().astype(np.int64), rows.column("component").to_numpy().copy()


def _likely(rows: pa.Table, similarity: int) -> pa.Table:
    """The rows with a partner across the cell, in another component, that sizes and parity maps let through."""
    one, two, n, component = _sides(rows)
    maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("parity").combine_chunks()]
    width = np.array([len(m) for m in maps])
    found = np.zeros(rows.num_rows, bool)
    for w in np.unique(width[one]):
        # a map of twice or half the size is folded; sizes further apart belong to sets too unlike
        for other in (w // 2, w, w * 2):
            near = two[width[two] == other]
            own = one[width[one] == w]
            if not len(near) or not len(own):
                continue
            low = min(w, other)
            fold = lambda m: m if len(m) == low else m[:low] ^ m[low:]
            held = np.stack([fold(maps[k]) for k in near])
            for k in own:
                at = np.flatnonzero((component[near] != component[k]) & (100 * np.minimum(n[near], n[k]) >= similarity * np.maximum(n[near], n[k])))
                if len(at):
                    d = np.bitwise_count(held[at] ^ fold(maps[k])).sum(axis=1, dtype=np.int64)
                    size = n[near[at]] + n[k]
                    at = at[100 * (size - d) >= similarity * (size + d)]
                    if len(at):
                        found[k] = True
                        found[near[at]] = True
    return rows.drop_columns(["parity"]).filter(pa.array(found))


def _cell_links(rows: pa.Table, similarity: int) -> pa.Table:
    """Links (a, b) across a cell, by exact intersections, that join its components: fewer than its rows."""
    one, two, n, component = _sides(rows)
    sets = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("shingles").combine_chunks()]
    spot = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(spot)[spot] > 1
    row, spot = row[often], np.unique(spot[often], return_inverse=True)[1].reshape(-1)
    order = np.argsort(spot, kind="stable")
    row, spot = row[order], spot[order]
    shared = np.zeros((len(one), len(two)), np.int32)
    for start in range(0, int(spot[-1]) + 1 if len(spot) else 0, COLUMNS):
        a, b = np.searchsorted(spot, (start, start + COLUMNS))
        at = (spot[a:b] - start).astype(U64)
        bits = np.zeros((len(sets), COLUMNS // 64), U64)
        np.bitwise_or.at(bits, (row[a:b], (at >> U64(6)).astype(np.int64)), U64(1) << (at & U64(63)))
        bits = bits[:, : (int(at[-1]) >> 6) + 1]
        held = bits[two]
        for i, k in enumerate(one):
            shared[i] += np.bitwise_count(held & bits[k]).sum(axis=1, dtype=np.int32)
    links = []
    for i, k in enumerate(one):
        # of each other component one link is enough, and none of one joined by then
        linked = 100 * shared[i].astype(np.int64) >= similarity * (n[two] + n[k] - shared[i])
        at = two[linked & (component[two] != component[k])]
        for c, j in zip(*np.unique(component[at], return_index=True)):
            links.append((k, at[j]))
            component[component == c] = component[k]
    ends = rows.column("num").to_numpy()[np.array(links, np.int64).reshape(-1, 2)]
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    one = label.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
    two = label.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
    named = pairs.join(one, "a", "left").join(two, "b", "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _bounded(pairs: DataFrame, parity_of, similarity: int) -> DataFrame:
    """The pairs (a, b) whose parity maps differ in no more bits than linked sets can; d is the share of these in a million."""

    def run(batches):
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            d = np.array([_differences(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            possible = 100 * (size - d) >= similarity * (size + d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(d * 1_000_000 // np.maximum(size, 1))], names=["a", "b", "d"]).filter(pa.array(possible))

    pairs = pack(pairs)
    maps = parity_of(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct())
    one = maps.select(F.col("num").alias("a"), F.col("n").alias("n"), F.col("parity").alias("x"))
    two = maps.select(F.col("num").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long, d long")


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b) of the pairs that link, by the exact comparison of whole sets."""

    def run(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[spot] == p).sum())
                linked[i] = 100 * both >= similarity * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked))

    one = sets.select(F.col("num").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("num").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def drop_near_duplicates(documents: DataFrame, text: str = "text", similarity: int = 80) -> DataFrame:
    """The documents with one row left of each component, that of its smallest doc_id; columns kept.

    Of repeated rows one stays. Documents with a null doc_id stay unless they link with or equal others: of
    a component without ids one row stays, and all without words. Columns may have any other names.
    """
    rows, of = _classes(documents.select("doc_id", text), text, similarity)
    kept = unused("kept", documents.columns)
    keep = _by_row(rows, of).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    out = documents.join(keep, documents["doc_id"] == F.col(kept), "left_semi").dropDuplicates(["doc_id"])

    def named(batches):
        for part, sets in _sets(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _ids(_fingerprints(sets))], names=["row", "n", "cid"])

    kind = StructType([StructField("row", documents.schema), StructField("n", LongType()), StructField("cid", BinaryType())])
    lone = documents.where(F.col("doc_id").isNull()).select(F.struct(*documents.columns).alias("row"), F.col(text).alias("text")).mapInArrow(named, kind)
    empty = lone.where("n = 0").select("row.*")
    lone = lone.join(of, F.col("cid") == F.col("c")).where("component_id is null").dropDuplicates(["component"]).select("row.*")
    return out.union(lone).union(empty).select(*documents.columns)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES: dict[str, str] = {}
