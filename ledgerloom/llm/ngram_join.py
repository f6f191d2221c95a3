"""N-gram Jaccard join of documents by a MinHash LSH forest, verified exactly.

A document is the set of its five-word shingles (ASCII letters lower-cased, words cut at white space;
fewer than five words make one shingle).  Two documents are linked when the Jaccard similarity of their
sets is at least the threshold.

1. One pass hashes every whole text: a key of the shingle set and, for each of ``TREES`` trees, a label of
   ``MOST_DEPTH`` MinHash values of two bytes, one behind the other, so that labels in byte order are the
   tree's sorted prefix trie and a trie node is a prefix.  Documents with equal sets form one *text*, known
   by its key (never by a document's id) and weighted by its number of documents.
2. Texts that share a node of the shortest prefix allowed (``prefix_depth``: the one at which pairs just at
   the threshold meet with the target recall) are kept with their exact sets, once.
3. The forest is searched from the deepest prefix.  Texts of one node are candidates: each is joined to the
   node's least text (a star, not all pairs), connected stars are candidate groups, and groups are verified
   on the exact sets.  What is found gives the recall reached: a verified pair of similarity s shares a
   prefix of d values in some tree with probability 1 - (1 - s^d)^trees, so found pairs stand for the sum of
   the inverse probabilities.  While that recall is below the target, prefixes are shortened to the longest at
   which the pairs found so far let it be expected (to the shortest if nothing is found); only groups that
   grow are verified again.  At the shortest prefix it ends.
4. A group is cut into bands of set size (a text can reach the threshold in its own band and the two beside
   it), and large bands into blocks; each pair of blocks is one task.  A task gives each text its number of
   linked documents and the least text that it is joined to, never pairs.
5. Classes are the connected components of exact links.

Result: one row per document with its class (the least doc_id of it), its number of linked documents,
copies included, and the class's numbers of documents and texts; ``class_key`` tells classes apart and
``text_hash`` the texts of one id.

Defined cases: null text is the empty text; texts without a word share no shingle and are linked to
nothing, not even to one another; a repeated row is one more document of its text; rows that share a
doc_id but not a text belong to their texts' classes, which may then bear the same class_id; rows with a
null doc_id are kept, alone, with a null class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.llm.textops import batches, chain, mix
from ledgerloom.operators.components import components
from ledgerloom.operators.positions import with_position
from ledgerloom.session import scratch_path, ship_package

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 24
MOST_DEPTH = 8
TARGET_RECALL = 0.999
#: Bins of similarity, from the threshold to 1, in which found pairs are counted.
SIMILARITY_BINS = 50
#: Bytes of text hashed at once (a longer single text is hashed whole).
SLICE_BYTES = 1 << 18
#: Shingles and texts per block of a large band.
BLOCK_SHINGLES = 200_000
BLOCK_TEXTS = 1024

_U = np.uint64


def prefix_depth(threshold: float, trees: int, most: int, recall: float) -> int:
    """Most MinHash values in a band at which a pair at the threshold still meets in one with that recall."""
    for depth in range(most, 0, -1):
        if 1 - (1 - threshold ** depth) ** trees >= recall:
            return depth
    return 1


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(419).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(batch, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin."""
    starts, ends, first = batch.words()
    hashes, begin = chain(batch.span_hashes(starts, ends), first, words)
    doc = np.repeat(np.arange(batch.rows), np.diff(begin))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(batch.rows + 1))


def signatures(hashes: np.ndarray, begin: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """MinHash values (trees * depth, documents with a shingle)."""
    full = begin[:-1][np.diff(begin) > 0]
    out = np.zeros((trees * depth, len(full)), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            for i, m in enumerate(_multipliers(trees * depth)):
                out[i] = np.minimum.reduceat((hashes * m) >> _U(16), full)
    return out


def sketch(docs: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """id, hash of the text, set key (two 64-bit numbers) and the trees' labels, of texts with a shingle."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, stop, batch in batches(part.column(1), limit=SLICE_BYTES):
                hashes, begin = shingle_sets(batch, words)
                full = np.flatnonzero(np.diff(begin) > 0)
                if not len(full):
                    continue
                signature = signatures(hashes, begin, trees, depth)
                labels = (signature >> _U(8)).astype(np.uint16).T.astype(">u2").copy()
                with np.errstate(over="ignore"):
                    key = [np.add.reduceat(mix(hashes + _U(c)), begin[:-1][full]) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).slice(start, stop - start).take(pa.array(full)) for i in (0, 2)], pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)),
                     pa.array([row.tobytes() for row in labels], pa.binary())],
                    names=["id", "text_hash", "k1", "k2", "labels"])

    return docs.mapInArrow(run, "id long, text_hash long, k1 long, k2 long, labels binary")


def exact_sets(texts: DataFrame, words: int) -> DataFrame:
    """tid, weight, n and the set of rows (tid, weight, text)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, stop, batch in batches(part.column(2), limit=SLICE_BYTES):
                hashes, begin = shingle_sets(batch, words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).slice(start, stop - start) for i in range(2)]
                    + [pa.array(np.diff(begin)), pa.array([hashes[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:])], pa.binary())],
                    names=["tid", "weight", "n", "grams"])

    return texts.select("tid", "weight", "text").mapInArrow(run, "tid long, weight long, n long, grams binary")


def compare(left: list[np.ndarray], right: list[np.ndarray], threshold: float):
    """(i, all j with Jaccard similarity at least the threshold, their similarities), one left set at a time.

    Right sets are laid end to end; a left set marks its hashes in the common dictionary, and one
    running sum counts the marks in every right set.
    """
    values, code = np.unique(np.concatenate(left + right), return_inverse=True)
    sizes = np.array([len(x) for x in right])
    cut = np.cumsum([0] + [len(x) for x in left] + list(sizes))
    ours, theirs = cut[:len(left) + 1], cut[len(left):]
    order = np.argsort(sizes, kind="stable")
    flat = np.concatenate([code[theirs[j]:theirs[j + 1]] for j in order]) if len(right) else code[:0]
    begin = np.concatenate([[0], np.cumsum(sizes[order])])
    mark = np.zeros(len(values), np.int32)
    for i in range(len(left)):
        own = code[ours[i]:ours[i + 1]]
        low = np.searchsorted(sizes[order], len(own) * threshold * (1 - 1e-12), "left")
        high = np.searchsorted(sizes[order], len(own) / threshold * (1 + 1e-12), "right")
        if low >= high:
            yield i, order[:0], np.zeros(0)
            continue
        mark[own] = 1
        common = np.add.reduceat(mark[flat[begin[low]:begin[high]]], begin[low:high] - begin[low])
        mark[own] = 0
        union = len(own) + sizes[order][low:high] - common
        hit = common >= threshold * union - 1e-9
        yield i, order[low:high][hit], common[hit] / union[hit]


def _verified(threshold: float):
    """Group function: links within one block, or between two, of a candidate group.

    Besides a row per text it returns a row per similarity bin (id -1 - bin) with twice its number of pairs."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        ids, weight, side = group["tid"].to_numpy(), group["weight"].to_numpy(), group["side"].to_numpy()
        own = bool(group["same"].iloc[0])
        left = np.arange(len(ids)) if own else np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        linked = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))
        bins = np.zeros(SIMILARITY_BINS, np.int64)

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(left) and len(right):
            for i, found, alike in compare([sets[x] for x in left], [sets[x] for x in right], threshold):
                a, b = left[i], right[found]
                if own:
                    b, alike = b[b != a], alike[b != a]
                linked[a] += weight[b].sum()
                if not own:
                    linked[b] += weight[a]
                at = np.clip(((alike - threshold) / max(1 - threshold, 1e-9) * SIMILARITY_BINS).astype(np.int64), 0, SIMILARITY_BINS - 1)
                bins += np.bincount(at, minlength=SIMILARITY_BINS) * (1 if own else 2)
                for x in b:
                    p, q = root(a), root(x)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        group_of = np.array([root(x) for x in range(len(ids))], np.int64)
        least = pd.Series(ids).groupby(group_of).transform("min").to_numpy() if len(ids) else ids
        full = np.flatnonzero(bins)
        return pd.DataFrame({"root": group["root"].iloc[0], "id": np.concatenate([ids, -1 - full]), "linked": np.concatenate([linked, bins[full]]), "joined": np.concatenate([least, -1 - full])})
    return run


def expected_recall(pairs: dict[int, int], found_at: int, depth: int, trees: int, threshold: float) -> float:
    """Share of the wanted pairs that prefixes of ``depth`` find, by the pairs (per similarity bin) found at ``found_at``."""
    meet = lambda s, d: 1 - (1 - s ** d) ** trees
    wanted = {threshold + (1 - threshold) * b / SIMILARITY_BINS: n for b, n in pairs.items()}
    wanted = {s: n / meet(s, found_at) for s, n in wanted.items()}
    return sum(n * meet(s, depth) for s, n in wanted.items()) / sum(wanted.values()) if wanted else 0.0


def next_depth(pairs: dict[int, int], depth: int, shortest: int, trees: int, threshold: float, recall: float) -> int:
    """The longest prefix at which the target recall is expected (``depth``: it is reached); ``shortest`` if nothing was found."""
    for shorter in range(depth, shortest, -1):
        if expected_recall(pairs, depth, shorter, trees, threshold) >= recall:
            return shorter
    return shortest


def _nodes(labels: DataFrame, trees: int, most: int, depth: int) -> DataFrame:
    """tid (or whatever else ``labels`` has) and the trie node of each tree at this depth, as one number."""
    each = F.array(*[F.xxhash64(F.lit(t), F.substring("labels", 1 + 2 * t * most, 2 * depth)) for t in range(trees)])
    return labels.withColumn("node", F.explode(each)).drop("labels")


def _blocks(sizes: DataFrame) -> DataFrame:
    """root, band and its number of blocks (``parts``), with those of the bands ``above`` and ``below`` it (null: no such band).

    ``sizes``: root, band, n of every text.  Each band tells its number to itself and to both neighbours, in one aggregate."""
    cells = (sizes.groupBy("root", "band").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
             .select("root", "band", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("count")))
    none = F.lit(None).cast("int")

    def told(band, **to):
        return F.struct(band.alias("band"), *[to.get(c, none).alias(c) for c in ("parts", "above", "below")])

    every = F.array(told(F.col("band"), parts=F.col("count")), told(F.col("band") - 1, above=F.col("count")), told(F.col("band") + 1, below=F.col("count")))
    return (cells.select("root", F.explode(every).alias("e")).select("root", "e.*").groupBy("root", "band")
            .agg(*[F.max(c).alias(c) for c in ("parts", "above", "below")]).filter("parts is not null"))


def _cells(sets: DataFrame, threshold: float, store) -> DataFrame:
    """The rows of ``sets`` (root, tid, weight, n, grams) dealt to the pairs of blocks that they meet in."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(threshold))) + F.lit(1e-9)).cast("int")
    sets = sets.withColumn("band", band)
    # Written: one small row per band, so that the join below is a plan of its own.
    cells = store(_blocks(sets.select("root", "band", "n")))
    sized = sets.join(cells.hint("merge"), ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int"))

    # A task compares blocks p and q of one band, or (up) block p of a band with block q of the next.
    def cell(low, p, q, up, side, same):
        return F.struct(low.cast("int").alias("low"), p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(up).alias("up"),
                        side.cast("int").alias("side"), same.alias("same"))

    def each(count, make):
        return F.transform(F.filter(F.sequence(F.lit(0), F.coalesce(count, F.lit(0))), lambda x: x < F.coalesce(count, F.lit(0))), make)

    own = each(F.col("parts"), lambda x: cell(F.col("band"), F.least(x, F.col("part")), F.greatest(x, F.col("part")), False, x < F.col("part"), x == F.col("part")))
    up = each(F.col("above"), lambda x: cell(F.col("band"), F.col("part"), x, True, F.lit(0), F.lit(False)))
    down = each(F.col("below"), lambda x: cell(F.col("band") - 1, x, F.col("part"), True, F.lit(1), F.lit(False)))
    return sized.select("root", "tid", "weight", "grams", F.explode(F.concat(own, up, down)).alias("c")).select("root", "tid", "weight", "grams", "c.*")


def _search(sets: DataFrame, labels: DataFrame, store, base: str, threshold: float, trees: int, most: int, shortest: int, recall: float) -> DataFrame:
    """id, linked, joined of the verified texts, by prefixes from ``most`` values down; see the module text."""
    groups, found, depth, reached = None, None, most, False
    while not reached:
        placed = labels if groups is None else labels.join(groups.hint("merge"), "tid", "left")
        root = F.col("tid") if groups is None else F.coalesce("root", "tid")
        nodes = _nodes(placed.select(root.alias("at"), "labels"), trees, most, depth)
        heads = nodes.groupBy("node").agg(F.min("at").alias("head"), F.max("at").alias("last")).filter("head <> last").drop("last")
        stars = nodes.join(heads.hint("merge"), "node").select(F.col("at").alias("a"), F.col("head").alias("b")).distinct()
        grown = components(stars, f"{base}/candidates-{depth}").withColumnsRenamed({"node": "old", "root": "new"})
        if groups is None:
            groups = grown.select(F.col("old").alias("tid"), F.col("new").alias("root"))
            again = groups
        else:
            # Texts that were alone have no group yet; groups that grew are verified again as a whole.
            every = labels.select("tid").join(groups.hint("merge"), "tid", "left").select("tid", F.coalesce("root", "tid").alias("old"), F.col("root").isNotNull().alias("was"))
            every = store(every.join(grown.hint("merge"), "old", "left").select("tid", F.coalesce("new", "old").alias("root"), F.col("new").isNotNull().alias("grew"), "was"), f"groups-{depth}")
            groups = every.filter("grew or was").select("tid", "root")
            again = every.filter("grew").select("tid", "root")
            # Texts are matched by their own number and bins summed per group first: a large group's rows stay spread.
            texts = found.filter("id >= 0").join(every.filter("grew").select(F.col("tid").alias("id")).hint("merge"), "id", "left_anti")
            counts = found.filter("id < 0").groupBy("root", "id").agg(F.sum("linked").alias("linked")).withColumn("joined", F.col("id"))
            counts = counts.join(grown.select("old").hint("merge"), counts["root"] == F.col("old"), "left_anti")
            found = texts.select("root", "id", "linked", "joined").unionByName(counts)
        checked = (_cells(sets.join(again.hint("merge"), "tid"), threshold, lambda df: store(df, f"blocks-{depth}")).groupBy("root", "low", "p", "q", "up")
                   .applyInPandas(_verified(threshold), "root long, id long, linked long, joined long"))
        found = store(checked if found is None else found.unionByName(checked), f"found-{depth}")
        pairs = {-1 - r.id: r.n // 2 for r in found.filter("id < 0").groupBy("id").agg(F.sum("linked").alias("n")).collect()}
        shorter = next_depth(pairs, depth, shortest, trees, threshold, recall)
        depth, reached = shorter, shorter == depth
    return found.filter("id >= 0")


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, trees: int = TREES,
         most_depth: int = MOST_DEPTH, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, class_docs, class_texts of every document; see the module text."""
    spark = docs.sparkSession
    ship_package(spark)
    base = scratch_path(spark, f"ngram-join-{uuid.uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    docs = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("text_hash", F.xxhash64("text"))
    shortest = prefix_depth(threshold, trees, most_depth, recall)
    rows = stored(sketch(docs.filter("doc_id is not null"), trees, most_depth, words), "sketch")
    # Equal sets: one text, with a number of its own and its least document.  Steps that later ones read more than
    # once are written, as each of them would otherwise hold the whole step in its plan, once for each time.
    least = F.min(F.struct("id", "text_hash"))
    texts = stored(with_position(rows.groupBy("k1", "k2").agg(least.alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("labels").alias("labels")), out="tid"), "texts")
    member = stored(rows.select("id", "text_hash", "k1", "k2").join(texts.select("k1", "k2", "tid").hint("merge"), ["k1", "k2"]).select("id", "text_hash", "tid"), "member")
    # Texts that share a node of the shortest prefix with another: only they can be found at any depth.
    nodes = _nodes(texts.select("tid", "labels"), trees, most_depth, shortest)
    shared = nodes.groupBy("node").agg(F.min("tid").alias("head"), F.max("tid").alias("last")).filter("head <> last").select("node")
    close = nodes.join(shared.hint("merge"), "node").select("tid").distinct()
    chosen = stored(texts.join(close.hint("merge"), "tid").select("tid", "weight", "labels", F.col("rep.id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash")), "close")
    named = docs.join(chosen.select("tid", "weight", "doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["tid"])
    sets = stored(exact_sets(named, words), "sets")
    found = _search(sets, chosen.select("tid", "labels"), stored, base, threshold, trees, most_depth, shortest, recall)
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    classes = components(found.select(F.col("id").alias("a"), F.col("joined").alias("b")), f"{base}/classes").withColumnRenamed("node", "id")
    text_class = (texts.select(F.col("tid").alias("id"), "weight", "rep").join(linked.hint("merge"), "id", "left").join(classes.hint("merge"), "id", "left")
                  .select(F.col("id").alias("tid"), F.coalesce("root", "id").alias("class_key"), "weight", F.col("rep.id").alias("rep"), F.coalesce("linked", F.lit(0)).alias("linked")))
    text_class = stored(text_class, "text-classes")
    sizes = text_class.groupBy("class_key").agg(F.sum("weight").alias("class_docs"), F.count(F.lit(1)).alias("class_texts"), F.min("rep").alias("class_id"))
    full = (member.join(text_class.join(sizes.hint("merge"), "class_key").hint("merge"), "tid")
            .select(F.col("id").alias("doc_id"), "class_id", (F.col("linked") + F.col("weight") - 1).alias("n_links"), "class_docs", "class_texts", "class_key", "text_hash"))
    # Documents without a shingle, or without an id, are alone.
    alone = docs.filter(F.col("doc_id").isNull() | F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    one = F.lit(1).cast("long")
    return full.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), one.alias("class_docs"),
                                         one.alias("class_texts"), F.lit(None).cast("long").alias("class_key"), "text_hash"))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each class, and every document that is alone without a word or an id.

    Kept is the class's least (doc_id, text_hash); of rows repeated under it the least by their other columns."""
    columns = docs.columns
    docs = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    best = (classes.filter("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
            .select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_kept")).distinct())
    rest = [F.col(f"`{c}`").cast("string") for c in columns if c not in ("doc_id", "text")]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    kept = docs.join(best, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_kept")), "left_semi")
    one = kept.groupBy("doc_id", "_hash").agg(F.min_by(whole, F.struct(*rest, "text")).alias("row")).select("row.*")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return one.unionByName(docs.filter(F.col("doc_id").isNull() | ~worded).drop("_hash"))
