"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class; classes are the rows of all that
follows. Bands of MinHash values name candidates. A candidate pair's signatures
are compared a batch at a time and given up as soon as the posterior probability
of reaching the threshold falls under the miss probability; the rest are verified
on full shingle sets. Links decide components alone, so a bucket first compares
its members with one pivot; only buckets that still hold several components have
their other pairs compared and verified, in blocks, with pairs inside a component left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.components import components
from turfline.llm.store import few, global_rank, map_arrow, stored
from turfline.llm.words import BYTE_VALUES, LOWER, find_words, gram_hashes, gram_starts, mix, span_hashes, text_slices

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: Bands of ROWS values: a pair at 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared before each decision, and the chance to lose a pair at the threshold.
BATCH, MISS = 32, 1e-6
#: Members of a bucket in a block, and about the shingles that they have together at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Rows of a task that holds signatures, texts or pairs of texts, where a table is too small for all shuffle partitions.
SIGNED, TEXTS, TEXT_PAIRS = 5_000, 1_000, 500
#: Rounds of pivots before the blocks.
PIVOT_ROUNDS = 2

_LOWER_VALUES = BYTE_VALUES[LOWER]
_RANDOM = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTORS, _FLIPS = _RANDOM[:HASHES] | np.uint64(1), _RANDOM[HASHES:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and their counts."""
    n = len(offsets) - 1
    starts, ends, first = find_words(data, offsets)
    words = span_hashes(data, starts, ends, _LOWER_VALUES)
    at, counts = gram_starts(first, k)
    grams, owner = gram_hashes(words, k)[at] if len(at) else words[:0], np.repeat(np.arange(n), counts)
    sizes = np.diff(first)
    for few in range(1, k):  # shorter texts: the whole sequence
        rows = np.flatnonzero(sizes == few)
        if len(rows):
            grams = np.concatenate([grams, gram_hashes(words, few, salt=few)[first[rows]]])
            owner = np.concatenate([owner, rows])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=n)


def signatures(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each non-empty set, one row for each."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for j in range(HASHES if len(starts) else 0):
        least = np.minimum.reduceat((grams ^ _FLIPS[j]) * _FACTORS[j], starts)
        out[:, j] = (mix(least) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS))
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return keys.view(np.int64)


@lru_cache(8)
def least_matches(hashes: int = HASHES, batch: int = BATCH, threshold: int = THRESHOLD, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the fewest equal values at which a pair goes on: below it the posterior
    probability, under a uniform prior, of the threshold or more is under ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= threshold / 100
    out = []
    for seen in range(batch, hashes + 1, batch):
        for m in range(seen + 1):
            log = m * np.log(grid) + (seen - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[high].sum() >= miss * weight.sum():
                out.append(m)
                break
    return tuple(out)


def plausible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indexes of the row pairs (x[i], y[i]) of signatures that no batch gave up."""
    alive, equal = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for i, least in enumerate(least_matches()):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
        alive = alive[equal[alive] >= least]
    return alive


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text), n_shingles, _set (digest of the set), _sig (bytes) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("_text", pa.int64()), ("n_shingles", pa.int64()), ("_set", pa.binary()), ("_sig", pa.binary())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offsets in text_slices(batch.column(2)):
                grams, counts = shingle_sets(data, offsets)
                full = counts > 0
                starts = (np.cumsum(counts) - counts)[full]
                digest = np.zeros((rows, 2), dtype=np.uint64)
                if len(starts):
                    digest[full, 0] = np.add.reduceat(mix(grams + np.uint64(77)), starts)
                    digest[full, 1] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sigs = iter(signatures(grams, counts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(counts.astype(np.int64)),
                    pa.array([d.tobytes() if f else None for d, f in zip(digest, full)], pa.binary()),
                    pa.array([next(sigs).tobytes() if f else None for f in full], pa.binary())], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text"), measure,
                     "doc_id long, _text long, n_shingles long, _set binary, _sig binary")


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _pruned(pairs: DataFrame, sigs: DataFrame, rows: int) -> DataFrame:
    """The pairs a, b, about ``rows``, whose signatures leave a link plausible."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(plausible(_signature_rows(batch.column(2)), _signature_rows(batch.column(3))))
                yield batch.select([0, 1]).take(keep)

    a, b = sigs.select(F.col("id").alias("a"), F.col("_sig").alias("_x")), sigs.select(F.col("id").alias("b"), F.col("_sig").alias("_y"))
    signed = few(few(few(pairs, rows).join(a, "a"), rows, SIGNED).join(b, "b"), rows, SIGNED)
    return map_arrow(signed.select("a", "b", "_x", "_y"), prune, "a long, b long")


def _texts(wanted: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """id, text of the classes ``wanted``: that of their first row. ``rows`` has the texts of all rows."""
    heads = classes.join(wanted, "id", "left_semi").select("id", "doc_id", "_text")
    texts = rows.join(heads, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("_text"))).select("id", "text")
    return texts.groupBy("id").agg(F.first("text").alias("text"))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles (ascending) reach the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def linked_with(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Whether each of the non-empty sets reaches the threshold with the non-empty set ``x`` (ascending, as all of them)."""
    sizes = np.array([len(y) for y in sets])
    grams = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, grams), len(x) - 1)
    both = np.add.reduceat((x[at] == grams).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= THRESHOLD * (len(x) + sizes - both)


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold."""
    pairs = stored(pairs, "pairs")
    n = pairs.count()
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = stored(few(_texts(few(wanted, 2 * n), classes, rows), 2 * n, TEXTS), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= 32:
                    known.clear()
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                known[key] = shingle_sets(data, np.array([0, len(data)]))[0]
            return known[key]

        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 32):  # so many pairs' texts at once
                for a, b, s, t in zip(*[c.to_pylist() for c in batch.slice(at, 32).columns]):
                    y, x = of(b, t), of(a, s)
                    if linked(x, y):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("_s")), texts.select(F.col("id").alias("b"), F.col("text").alias("_t"))
    # a pivot may stand in very many pairs: only this join's left side is skewed, and it can be split
    full = few(pairs.join(x, "a").join(y, "b"), n, TEXT_PAIRS)
    return stored(map_arrow(full.select("a", "b", "_s", "_t"), verify, "a long, b long"), "links")


def _sized(texts: DataFrame) -> DataFrame:
    """id and _set (hashes of its shingles, ascending, 8 bytes each) of texts ``id, text``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offsets in text_slices(batch.column(1)):
                grams, counts = shingle_sets(data, offsets)
                ends = np.concatenate([[0], np.cumsum(counts)])
                sets = pa.array([grams[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), sets], names=["id", "_set"])

    return map_arrow(texts.select("id", "text"), measure, "id long, _set binary")


def _block_jobs(members: DataFrame) -> tuple[DataFrame, int]:
    """Members ``id, root, n, class`` of buckets ``key`` with several components, dealt to jobs of two blocks: each
    with the job and whether it is in its ``left`` and ``right`` block; and
    the number of members. Blocks without a possible link make no job."""
    n = members.count()
    mixed = members.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l < _h").select("key")
    members = members.join(mixed, "key", "left_semi").select("key", "root", "id", "n", "class")
    members = stored(few(members, n), "mixed")  # ranking reads it twice
    ranked = global_rank(members, [F.col("key"), F.col("class"), F.col("root"), F.col("id")])
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"shiftright({BLOCK_SHINGLES}, class)")))
    ranked = ranked.withColumn("block", F.struct("class", F.floor(F.col("_rank") / most).alias("no"))).drop("_rank")
    ranked = stored(ranked, "blocks")
    n = ranked.count()
    parts = few(ranked.groupBy("key", "block").agg(F.min("root").alias("_l"), F.max("root").alias("_h")), n)
    left = parts.select("key", F.col("block").alias("x"), F.col("_l").alias("_xl"), F.col("_h").alias("_xh"))
    right = parts.select("key", F.col("block").alias("y"), F.col("_l").alias("_yl"), F.col("_h").alias("_yh"))
    work = left.join(right, "key").where("x <= y and y.class - x.class <= 1 and not (_xl = _yh and _xh = _yl and _xl = _xh)")
    jobs = few(work, n).select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    jobs = few(jobs.join(ranked.select("key", "block", "id", "root", "n"), ["key", "block"]), n)
    return jobs.select(
        F.struct("key", "x", "y").alias("job"), "id", "root", "n", (F.col("block") == F.col("x")).alias("left"), (F.col("block") == F.col("y")).alias("right")), n


def _candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row of a job with the right rows that may be linked with it and are in another component."""
    ids, roots, sizes = (table.column(c).to_numpy() for c in ("id", "root", "n"))
    sig = _signature_rows(table.column("_sig").combine_chunks())
    lefts, rights = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
    same = bool(np.array_equal(lefts, rights))
    for i in lefts:
        others = rights[ids[rights] > ids[i]] if same else rights
        fits = 100 * np.minimum(sizes[others], sizes[i]) >= THRESHOLD * np.maximum(sizes[others], sizes[i])
        others = others[(roots[others] != roots[i]) & fits]
        others = others[plausible(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others])]
        if len(others):
            yield i, others[np.argsort(-(sig[others] == sig[i]).sum(axis=1), kind="stable")]


def _pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _block_pairs(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """All pairs a, b of different components in buckets ``key`` with members ``id, root`` whose signatures leave
    a link plausible, whatever their sizes. (``_block_links`` goes through the same jobs and emits links only.)"""

    def pairs(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        return _pair_table([(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, others in _candidates(table) for j in others])

    jobs, _ = _block_jobs(members.select("key", "root", "id", F.lit(1).cast("long").alias("n"), F.lit(0).alias("class")))
    return jobs.join(sigs, "id").groupBy("job").applyInArrow(lambda t: pairs(t), "a long, b long").distinct()


def _block_links(members: DataFrame, sigs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between different components in buckets ``key`` with members ``id, root``.

    Members are ranked over all buckets by bucket, size class (the power of two below the number of
    shingles) and component, and cut into blocks of at most ``BLOCK`` members and about ``BLOCK_SHINGLES``
    shingles. Pairs of blocks that share a bucket are compared unless both lie in one component or
    their sizes rule out a link: first by signatures, which leaves the members with a plausible partner,
    then by the full sets of these, which each block brings once. Only links that join two components leave
    a task, fewer than its members, however many pairs are plausible.
    """
    sized = members.join(classes.select("id", "n", F.floor(F.log2("n")).cast("int").alias("class")), "id")
    sized = stored(few(sized, members.count()), "sized")
    jobs, n = _block_jobs(sized)

    def with_partner(table: pa.Table) -> pa.Table:
        marked = np.zeros(table.num_rows, dtype=bool)
        for i, others in _candidates(table):
            marked[i] = marked[others] = True
        return table.select(names).filter(pa.array(marked))

    names = jobs.columns
    signed = few(jobs.join(sigs, "id"), n, SIGNED)
    survivors = stored(few(signed.groupBy("job").applyInArrow(lambda t: with_partner(t), jobs.schema), n, TEXTS), "survivors")
    n = survivors.count()
    sets = _sized(few(_texts(few(survivors.select("id").distinct(), n), classes, rows), n, TEXTS)).select("id", "_set")

    def link(table: pa.Table) -> pa.Table:
        ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
        grams = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table.column("_set").combine_chunks()]
        to = {int(r): int(r) for r in roots}

        def root(r: int) -> int:
            while to[r] != r:
                to[r] = to[to[r]]
                r = to[r]
            return r

        found = []
        for i, others in _candidates(table):
            for at in range(0, len(others), 64):  # so many sets at once: links found before may have joined the rest
                rest = [j for j in others[at:at + 64] if root(int(roots[j])) != root(int(roots[i]))]
                for j in np.array(rest)[linked_with(grams[i], [grams[j] for j in rest])] if rest else []:
                    if root(int(roots[j])) != root(int(roots[i])):
                        found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                        to[root(int(roots[j]))] = root(int(roots[i]))
        return _pair_table(found)

    full = few(survivors.join(sigs, "id").join(sets, "id"), n, TEXTS)
    links = few(full.groupBy("job").applyInArrow(lambda t: link(t), "a long, b long"), n, TEXTS)
    return stored(few(links.distinct(), n), "links")


def _components(docs: DataFrame) -> DataFrame:
    sets = stored(with_sets(docs), "sets")
    classed = sets.where(F.col("_set").isNotNull()).select(F.xxhash64("_set").alias("id"), "doc_id", "_text", F.col("n_shingles").alias("n"), "_sig")
    classes = classed.groupBy("id").agg(F.min(F.struct("doc_id", "_text")).alias("_r"), F.max("n").alias("n"), F.first("_sig").alias("_sig"))
    n = sets.count()
    classes = stored(few(classes.select("id", "_r.*", "n", "_sig"), n, SIGNED), "classes")
    roots = components(_class_links(classes, docs))
    # classes by component, then rows by class: neither gathers the rows of a class
    rooted = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first_ids = classed.groupBy("id").agg(F.min("doc_id").alias("_first"))
    rooted = stored(few(rooted.select("id", "root").join(first_ids, "id"), n), "roots")
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = few(rooted.join(least, "root"), n).select("id", F.col("root").alias("_root"), "component_id")
    out = sets.select("doc_id", "_text", "n_shingles", F.when(F.col("_set").isNotNull(), F.xxhash64("_set")).alias("id")).join(named, "id", "left")
    out = few(out, n)
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).drop("id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    A null or empty text, and one without words, has no shingles and is linked with nothing. The
    component is named by its smallest doc_id; nulls count only if there is no other. A row with a
    null doc_id is kept, rows that share the smallest doc_id are all kept. An empty frame gives an
    empty frame.
    """
    return _components(docs).drop("_text", "_root")


def _class_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    spark, sigs, n = classes.sparkSession, classes.select("id", "_sig"), classes.count()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = band_keys(_signature_rows(batch.column(1)))
                ids = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bands.ravel())], names=["id", "key"])

    bands = map_arrow(sigs.select("id", "_sig"), keys, "id long, key long")
    bands = stored(bands, "bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    bands = stored(few(bands.join(shared, "key", "left_semi"), BANDS * n), "buckets")
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    links = spark.createDataFrame([], "a long, b long")
    members = bands.withColumn("root", F.col("id"))
    for turn in range(PIVOT_ROUNDS + 1):
        if turn == PIVOT_ROUNDS:
            links = links.unionByName(_block_links(members, sigs, classes, rows))
        else:
            heads = members.groupBy("key", "root").agg(F.min("id").alias("a")) if turn else members.select("key", "root", F.col("id").alias("a"))
            pivots = members.groupBy("key").agg(F.min(F.struct("root", "id")).alias("_p"))
            apart = few(heads.join(pivots, "key").where("root <> _p.root"), BANDS * n).select("a", F.col("_p.id").alias("b"))
            pairs = apart.distinct() if turn else apart.groupBy("a").agg(F.min("b").alias("b"))
            links = links.unionByName(_verified(_pruned(pairs, sigs, n), classes, rows))
            roots = components(links)
            members = bands.join(roots, "id", "left").select("id", "key", F.coalesce("root", "id").alias("root"))
            members = stored(few(members, BANDS * n), "members")
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of ``docs`` for each component, all columns; rows without shingles all stay.

    The row with the smallest doc_id stays (nulls last), then that with the smallest hash of its
    text; of rows equal in both, that with the smallest hash of all columns.
    """
    rows = stored(_components(docs).where(F.col("_root").isNotNull()).select("_root", "doc_id", "_text"), "rooted")
    # rows, then keys, are counted and compared before they are dealt: no task holds the rows of a component
    keys = rows.groupBy("_root", "doc_id", "_text").agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_text")).alias("_f"))
    first = first.select(F.col("_f.doc_id").alias("_doc"), F.col("_f._text").alias("_hash"))
    keys = keys.join(first, keys["doc_id"].eqNullSafe(first["_doc"]) & (keys["_text"] == first["_hash"]), "left")
    keys = stored(keys.where("_hash is null or _n > 1").select(
        F.col("doc_id").alias("_key"), "_text", F.col("_hash").isNotNull().alias("_stays")), "gone")

    def same(table: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(table["_key"]) & (F.xxhash64(docs["text"]) == table["_text"])

    single = docs.join(keys, same(keys), "left_anti")
    repeated = keys.where("_stays").drop("_stays")
    repeated = docs.join(repeated, same(repeated), "left_semi").groupBy(
        F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_text")).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return single.unionByName(repeated.select("_row.*"))
