"""Near-duplicate join on word shingles: MinHash bands, then exact verification.

1. Each text gives its set of hashed shingles of five words, ``TREES`` short signatures (the labels along a path of a prefix
   tree) and ``TREES * DEPTH`` single bytes of the same minima. Rows of equal texts form a class; the rest of the work is done
   once per class.
2. In every tree two classes meet if they share a prefix. Its depth is fixed in advance by constants, never by the data: the
   longest one at which the expected share of pairs at the threshold that meet in some tree reaches ``RECALL``. So the trees
   are bands of minima; the order of the longer prefixes inside a bucket is not used to pick pairs.
3. Inside a bucket, byte signatures pick likely pairs; they are reduced to one link per class at once, so no pair leaves a
   task. Large buckets are split into blocks, and every two blocks meet in a task of their own.
4. Connected components of those links are verified exactly: all pairs of a component are counted through an index of shared
   shingles, large ones again by blocks. The component also holds pairs that no bucket brought together.

A class has a row per document with its exact number of linked classes; groups are components of exact links.
"""

from __future__ import annotations

from collections.abc import Iterator

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, keyed, materialise, split_by, table, text_of, unkeyed, unused, without
from .groups import components, merge_labels, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.999
# A pair at the threshold agrees in fewer signature bytes with a chance of about 1e-5.
LIKELY = 0.62
BUCKET_BLOCK = 1024
GROUP_BLOCK = 512
KEPT = 400_000
_split = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = str.maketrans(UPPER, UPPER.lower())
_RNG = np.random.default_rng(41)
_A = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_M = np.uint64(0xFF51AFD7ED558CCD)


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, longest: int = DEPTH) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target, by shortening."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Words(dict):
    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        h = (zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], len(raw))) & 0xFFFFFFFFFFFFFFFF
        self[word] = h
        return h


def shingles(text: str, words: Words, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashed shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    tokens = _split(text.translate(_LOWER))
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(words) > KEPT:
        words.clear()
    codes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(width, len(codes))
    h = np.full(len(codes) - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ codes[j:j + len(h)]) * _M
        h ^= h >> np.uint64(31)
    return np.unique(h)


def minima(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of keyed hashes of the shingles."""
    out = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        part = found[at:at + 4096]
        h = part[None, :] * _A[:, None] + _B[:, None]
        np.minimum(out, (h ^ (h >> np.uint64(33))).min(1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_key, n, keys, marks): shingles, prefix hashes per tree and the signature bytes; keys empty without shingles."""
    rows, kind = keyed(docs, id_col, text_col)
    rows = rows.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    depth = depth_for()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            sizes, keys, marks = [], [], []
            for text in frame["text"]:
                found = shingles(text, words)
                sizes.append(len(found))
                if not len(found):
                    keys.append([])
                    marks.append(b"")
                    continue
                low = minima(found).reshape(TREES, DEPTH)
                h = np.arange(TREES, dtype=np.uint64)
                for j in range(depth):
                    h = (h ^ low[:, j]) * _M
                    h ^= h >> np.uint64(29)
                keys.append(h.view(np.int64).tolist())
                marks.append((low * _M >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_key": frame["text_key"], "n": sizes, "keys": keys, "marks": marks})

    return unkeyed(rows.mapInPandas(batches, "doc_id string, text_key binary, n int, keys array<long>, marks binary"), kind)


def blocked(df: DataFrame, key: list[str], item: str, size: DataFrame, block: int) -> DataFrame:
    """Adds (i, j), the pair of blocks a row takes part in: one for groups up to ``block``, else as many as the group has blocks."""
    joined = df.join(size, key).withColumn("_blocks", F.ceil(F.col("members") / block).cast("int"))
    own = F.pmod(F.xxhash64(item, F.lit(3)), F.col("_blocks")).cast("int")
    return joined.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *df.columns, "_own", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))


def likely_links(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between classes whose signatures agree, from each to the first of those connected with it in a bucket."""
    slim = reps.select("class_id", F.posexplode("keys").alias("tree", "key"))
    size = slim.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = blocked(slim, ["tree", "key"], "class_id", size, BUCKET_BLOCK).join(reps.select("class_id", "marks"), "class_id")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["tree", "key", "i", "j"]):
            new = (frame[["tree", "key", "i", "j"]].to_numpy()[1:] != frame[["tree", "key", "i", "j"]].to_numpy()[:-1]).any(1)
            group = np.concatenate([[0], np.cumsum(new)])
            ids = frame["class_id"].to_numpy()
            marks = np.frombuffer(b"".join(frame["marks"]), np.uint8).reshape(len(frame), -1)
            n = len(frame)
            label = np.arange(n)
            for off in range(1, n):
                at = np.flatnonzero(group[:-off] == group[off:])
                if not len(at):
                    break
                for part in np.array_split(at, max(1, len(at) // 20_000)):
                    same = (marks[part] == marks[part + off]).mean(1) >= LIKELY
                    label = merge_labels(label, part[same], part[same] + off)
            linked = label != np.arange(n)
            yield pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    keys = ["tree", "key", "i", "j"]
    path = F.expr(f"substring(marks, tree * {DEPTH} + 1, {DEPTH})")
    return met.repartition(*keys).sortWithinPartitions(*keys, path).mapInPandas(batches, "a long, b long").distinct()


def pair_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left`` the exact Jaccard similarity to all of ``right``, through an index of right's shingles."""
    sizes = np.array([len(x) for x in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    pool = np.concatenate(right)
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    for k, own in enumerate(left):
        lo, hi = np.searchsorted(pool, own, "left"), np.searchsorted(pool, own, "right")
        runs = hi - lo
        total = int(runs.sum())
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(right))
        yield k, common / (len(own) + sizes - common)


def exact_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (class_id, links, least): exact links inside components and one class linked through links, by blocks."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            yield pd.DataFrame({"class_id": frame["class_id"], "found": [shingles(t, words).tobytes() for t in frame["text"]]})

    sets = materialise(texts.mapInPandas(batches, "class_id long, found binary").dropDuplicates(["class_id"]))
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    met = blocked(members, ["root"], "class_id", size, GROUP_BLOCK).join(sets, "class_id")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["root", "i", "j"]):
            out = []
            for (_, i, j), g in frame.groupby(["root", "i", "j"], sort=False):
                ids, own = g["class_id"].to_numpy(), g["_own"].to_numpy()
                sets_ = [np.frombuffer(x, np.uint64) for x in g["found"]]
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                if not len(left) or not len(right):
                    continue
                links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for k, similar in pair_counts([sets_[x] for x in left], [sets_[x] for x in right]):
                    a, hits = left[k], right[similar >= THRESHOLD]
                    hits = hits[hits != a]
                    if len(hits):
                        links[a] += len(hits)
                        label = merge_labels(label, np.full(len(hits), a), hits)
                        if i != j:
                            links[hits] += 1
                out.append(pd.DataFrame({"class_id": ids, "links": links, "least": ids[label]})[links > 0])
            yield pd.concat(out) if out else pd.DataFrame({"class_id": [], "links": [], "least": []})

    keys = ["root", "i", "j"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "class_id").mapInPandas(verify, "class_id long, links long, least long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, text_key, class_id) of all rows and (class_id, n_links, group_id) of classes with links.

    A class is named by a number per distinct text: the smallest doc_id if ids are distinct integers, which the caller
    guarantees; rows with a null id have classes of hashes below zero.
    """
    signed = materialise(signatures(docs, id_col, text_col))
    number = F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text_key")) - 1)
    named = signed.groupBy("text_key").agg(F.min(number).alias("least"), F.min_by("keys", number).alias("keys"), F.min_by("marks", number).alias("marks"))
    # Two texts share their smallest id only if that id is repeated; then the hash names the class.
    twice = named.groupBy("least").agg(F.count(F.lit(1)).alias("texts"))
    named = materialise(named.join(twice, "least").withColumn(
        "class_id", F.when(F.col("texts") == 1, F.col("least")).otherwise(-F.abs(F.xxhash64("text_key")) - 1)).drop("least", "texts"))
    rows = materialise(signed.select("doc_id", "text_key").join(named.select("text_key", "class_id"), "text_key"))
    links = likely_links(named.where(F.size("keys") > 0))
    members = materialise(components(links).select(F.col("node").alias("class_id"), "root"))
    texts = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("text")).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    wanted = materialise(rows.join(members, "class_id").groupBy("class_id").agg(F.first("text_key").alias("w_key"), F.min("doc_id").alias("w_id")))
    # Only texts of components move.
    chosen = split_by(texts, "text_key", wanted, "w_key")[0].join(wanted, (F.col("text_key") == F.col("w_key")) & F.col("d_id").eqNullSafe(F.col("w_id"))).select("class_id", "text")
    found = materialise(exact_links(chosen, members))
    exact = found.groupBy("class_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("class_id").alias("a"), F.col("least").alias("b")))
    return rows, materialise(exact.join(groups.select(F.col("node").alias("class_id"), F.col("root").alias("group_id")), "class_id"))


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, group_id.

    ``class_id`` is the smallest doc_id with exactly this text, ``n_links`` the number of other
    distinct texts whose sets of five-word shingles (A-Z lower-cased) have a Jaccard similarity
    of at least 0.8 with it, ``group_id`` the smallest class connected through links. Texts of
    fewer than five words are one shingle; texts without words, null counting as empty, have no
    links. Repeated rows repeat their answer.
    """
    rows, linked = near_classes(docs, id_col, text_col)
    return rows.join(linked, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose class stays: of each group of linked classes the one that names it; own columns only.

    Classes without links stay with all their rows, so exact copies are left to exact de-duplication.
    """
    rows, linked = near_classes(docs, id_col, text_col)
    key, own = unused(docs, "_gone"), unused(docs, "_key")
    gone = materialise(rows.join(linked.where("class_id <> group_id"), "class_id").select(
        F.col("text_key").alias(key)).distinct())
    named = docs.withColumn(own, F.unhex(F.md5(text_of(text_col).cast("binary"))))
    return without(named, own, gone, key).select(docs.columns)


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents"))
