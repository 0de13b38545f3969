"""Conversation repair, bisector clustering and covering fingerprints against SQL and plain versions."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

from citegraph.llm import bisector, catalogue, covering, decontaminate, exact_dedup, mixing, near_join, quality, repair, repeats, toxicity  # noqa: E402
from citegraph.llm.common import materialise  # noqa: E402
from citegraph.llm.groups import components  # noqa: E402

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string"
ANSWER = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def from_sql(sql, names, **tables):
    con = duckdb.connect()
    for name, made in tables.items():
        con.execute(f"CREATE TABLE {name} AS {made}")
    return by_id(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())


def talk_sql(rows):
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT CAST(a AS BIGINT) AS conv_id, CAST(b AS BIGINT) AS turn, CAST(c AS VARCHAR) AS role, CAST(d AS VARCHAR) AS text FROM (VALUES {values}) v(a, b, c, d)"


def odd_talks(seed, conversations, sizes):
    rng = random.Random(seed)
    texts = ["Hi.", "ok", "Well!  ", "", " \t ", None, "Ünïcode ☃?"]
    return [
        (None if c % 40 == 3 else c, rng.choice([k, k, k, None, k - 1, k + 3]),
         rng.choice(["user", "assistant", "system", "tool", "assistant", "user", None, "", "u2"]),
         rng.choice([*texts, f"a{k}.", f"b{k}?", f"c{k}", f"d{k}.\n"]))
        for c in range(conversations) for k in range(rng.choice(sizes))
    ]


def best_edits(rows):
    """(cost, audit, lines) of the cheapest edits, by trying all, with up to two insertions in any place."""
    seen, options = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\r\x0b\x0c")
        bad = not body or (role, text) in seen
        seen.add((role, text))
        cut = 5 if body and not bad and body[-1] not in ".!?" else 0
        options.append([(2, "D", None)] + ([] if bad else [
            (cut, "K", (role[:1], role, text)), (cut + 1, "R", ("u", "user", text)), (cut + 1, "R", ("a", "assistant", text))]))
    extra = [[]] + [[(5, "I", (r[:1], r, ""))] for r in ("user", "assistant")] + [
        [(5, "I", ("u", "user", "")), (5, "I", ("a", "assistant", ""))], [(5, "I", ("a", "assistant", "")), (5, "I", ("u", "user", ""))]]
    best = None
    for chosen in itertools.product(*options):
        for places in itertools.product(extra, repeat=len(rows) + 1):
            if sum(map(len, places)) > 3:
                continue
            edits = list(places[0])
            for edit, more in zip(chosen, places[1:]):
                edits += [edit, *more]
            if re.fullmatch(r"(?:s?(?:ua)+)?", "".join(e[2][0] or "?" for e in edits if e[2])):
                way = (sum(e[0] for e in edits), "".join(e[1] for e in edits), [f"{e[2][1]}:{e[2][2]}" for e in edits if e[2]])
                best = min(best, way) if best else way
    return best


def test_repair_against_sql(spark):
    expected = from_sql(catalogue.ORACLES["op11_repair"], ANSWER, conversations=f"SELECT * FROM '{SF}/conversations.parquet'")
    assert by_id(tuple(r) for r in catalogue.QUERIES["op11_repair"](spark, SF).select(ANSWER).collect()) == expected


def test_repair_of_odd_and_long_conversations(spark):
    rows = odd_talks(1, 160, [1, 2, 3, 5, 9, 17]) + [(900, k, "user", f"t{k % 700}.") for k in range(2000)]
    talks = spark.createDataFrame([(*r, 1, "x") for r in rows], TALK + ", cost long, gone string")
    got = by_id(tuple(r) for r in repair.repair_conversations(talks).collect())
    assert got == from_sql(repair.ORACLE, ANSWER, conversations=talk_sql(rows))
    assert {r[0] for r in got} == {r[0] for r in rows}
    again = by_id(tuple(r) for r in repair.repair_conversations(talks.repartition(7, "text")).collect())
    assert again == got


def test_repair_against_all_edits(spark):
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "ok", " ", "No!"])) for _ in range(rng.choice([1, 2, 3]))]
        talk = repair.Conversation()
        seen = set()
        for role, text in rows:
            talk.add("1", role, text, (role, text) in seen)
            seen.add((role, text))
        cost, audit, lines = best_edits(rows)
        assert talk.answer()[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], TALK)).collect() == []
    dropped = next(k for k in range(1000) if plain.zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = repair.repair_conversations(spark.createDataFrame([(dropped, 0, "user", "Hi.")], TALK)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def plain_clusters(vectors, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centres[j] = [sum(column) // len(members) for column in zip(*members)]
    final = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, o in final if o == j) for j in range(len(centres))}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return by_id((i, j, d, total[j], sum(total.values()), hashes[j]) for i, d, j in final)


def test_bisector_against_sql(spark):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    expected = from_sql(catalogue.ORACLES["op12_bisector"], names, embeddings=f"SELECT * FROM '{SF}/embeddings.parquet'")
    assert by_id(tuple(r) for r in catalogue.QUERIES["op12_bisector"](spark, SF).select(names).collect()) == expected


@pytest.mark.parametrize("size", [1.0, 200_000.0])
def test_bisector_of_odd_vectors(spark, size):
    rng = random.Random(6)
    # Few distinct components make ties; the larger size leaves 64-bit products behind.
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5]) * (size if d == 0 else 1.0) for d in range(64)]) for i in range(120)]
    vectors += [vectors[5], (5, vectors[6][1]), (None, vectors[7][1]), (200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65),
                (204, [None] + [0.5] * 63), (205, [float("nan")] + [0.5] * 63), (206, [float("inf")] + [0.5] * 63)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, cluster int, x int")
    assert by_id(tuple(r) for r in bisector.bisector_clusters(frame).collect()) == plain_clusters(vectors)


def test_bisector_with_few_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    assert bisector.bisector_clusters(spark.createDataFrame([], shape)).collect() == []
    vectors = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-0.1] * 64)]
    assert by_id(tuple(r) for r in bisector.bisector_clusters(spark.createDataFrame(vectors, shape)).collect()) == plain_clusters(vectors)


def plain_fingerprint(text):
    words = plain.words((text or "").translate(plain.LOWER))
    k = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(bits, radius=4):
    """Smallest position connected with each position."""
    label = list(range(len(bits)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(bits)):
        for b in np.flatnonzero(np.bitwise_count(bits[a + 1:] ^ bits[a]) <= radius) + a + 1:
            x, y = root(a), root(int(b))
            label[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(bits))]


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    of = dict(zip(distinct, roots(np.array(distinct, np.uint64))))
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return by_id((i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, prints))


def test_masks_hide_every_choice():
    masks = covering.covering_masks(list(range(64)))
    rng = random.Random(2)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 4))
        first = [m for m in masks if not any(m >> b & 1 for b in bits)]
        assert first
        second = [f for f in covering.finer_masks(first[0]) if not any(f >> b & 1 for b in bits)]
        assert second and any(not any(f >> b & 1 for b in bits) for f in covering.finer_masks(second[0]))
    last = {g for m in masks for f in covering.finer_masks(m) for g in covering.finer_masks(f)}
    assert max(len(covering.hidden(m)) for m in last) <= 8


def test_simhash(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert by_id(tuple(r) for r in catalogue.QUERIES["op13_simhash"](spark, SF).collect()) == plain_groups(rows)


def test_simhash_of_odd_texts(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (None, "One two"), (5, "one TWO"), (5, "one two"), (6, "a b c d"), (7, "Ünïcode ☃ x y z q"), (8, "x " * 40_000)]
    for i in range(40):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(300)] = f"n{i}"
        rows.append((20 + i, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, fp int, n int, known string")
    assert by_id(tuple(r) for r in covering.simhash_groups(docs).collect()) == plain_groups(rows)
    assert by_id(tuple(r) for r in covering.simhash_groups(docs, frequent=2.0).collect()) == plain_groups(rows)
    assert covering.simhash_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_of_large_buckets(spark, bucket):
    rng = random.Random(3)
    prints = set()
    for _ in range(2):
        base = rng.getrandbits(64)
        for _ in range(250):
            prints.add(covering.signed(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))))
    prints = sorted(prints)
    links = covering.covered_links(spark.createDataFrame([(p,) for p in prints], "fp long"), bucket=bucket)
    got = {r["node"]: r["root"] for r in components(links).where(F.col("node") != F.col("root")).collect()}
    assert got == {prints[i]: prints[r] for i, r in enumerate(roots(np.array(prints).view(np.uint64))) if r != i}


def test_rows_of_buckets_are_not_broadcast(spark):
    rng = random.Random(8)
    prints = spark.createDataFrame([(covering.signed(rng.getrandbits(12) << 30),) for _ in range(600)], "fp long").distinct()
    masks = [covering.signed(m) for m in covering.covering_masks(list(range(64)))]
    rows = materialise(prints).select(F.explode(F.array(*map(F.lit, masks))).alias("mask"), "fp")
    met = covering.buckets(rows)
    every = [(r["mask"], r["mask"] & r["fp"], r["fp"]) for r in rows.collect()]
    size = collections.Counter(k[:2] for k in every)
    assert sorted((r["mask"], r["key"], r["fp"], r["members"]) for r in met.collect()) == sorted((*k, size[k[:2]]) for k in every if size[k[:2]] > 1)
    # Behind the explode there are 31 times the rows that Spark counts on; at this size it would broadcast them.
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()


def held_out_auc(rows, labels):
    known = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = ([s for s, y in known if y == side] for side in (1, 0))
    return sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean)), known


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    auc, known = held_out_auc(catalogue.QUERIES["op1_toxicity"](spark, sf).collect(), labels)
    assert auc > 0.85 and sum((s >= 0.7) == y for s, y in known) >= 0.95 * len(known)


@pytest.mark.parametrize("n, n_toxic", [(60, 30), (300, 30), (80, 20)])
def test_toxicity_without_telling_words_keeps_the_odds(n, n_toxic):
    rng = random.Random(n)
    toxic = np.array([k < n_toxic for k in range(n)])
    field = toxicity.fit([" ".join(f"u{rng.randrange(10**9)}" for _ in range(20)) for _ in range(n)], toxic, n_toxic / (n - n_toxic))
    score = field.score(field.evidence(field.tag([f"v{k} w{k}" for k in range(20)])))
    assert np.allclose(score, n_toxic / n, atol=0.1) and (field.slopes >= 0).all()


def test_mixing_exchanges_copies_in_small_sources(spark):
    rng = random.Random(12)
    rows = [(s * 100 + k, "w " * rng.choice([90, 170, 260, 310, 420, 777]), f"s{s}") for s in range(9) for k in range(8)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        sums = {0}
        for r in own:
            sums = {x + c * r["size"] for x in sums for c in range(4)}
        nearest = min(abs(x - own[0]["target"]) for x in sums)
        miss = abs(sum(r["taken"] for r in own) - own[0]["target"])
        assert miss <= max(nearest, 0.01 * own[0]["target"]) and all(0 <= r["copies"] <= 3 for r in own)


def test_stage_functions_with_columns_of_their_own_names(spark):
    text = "one two three four five six seven eight nine ten eleven twelve "
    docs = spark.createDataFrame(
        [(1, text, "s", 1), (2, text + "thirteen", "s", 2), (2, text, "s", 3), (None, None, None, 4)], "doc_id long, text string, source string, _gone int")
    for name in ("_loser", "_leak_id", "_leak_key", "_taken", "_row", "text_key", "class_id"):
        docs = docs.withColumn(name, F.col("_gone") * 10)
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r["_gone"] for r in exact_dedup.drop_copies(docs).collect()) in ([1, 2, 4], [2, 3, 4])
    assert [r["_leak_key"] for r in decontaminate.drop_leaks(docs, items).collect()] == [40]
    assert near_join.keep_one(docs).columns == docs.columns and near_join.keep_one(docs).count() >= 2
    assert mixing.mixed_rows(docs).columns == [*docs.columns, "copies", "shard", "place"] and mixing.mixed_rows(docs).count() >= 1
    none = docs.limit(0)
    for out in (quality.keep_good(none, labels), exact_dedup.drop_copies(none), near_join.keep_one(none), decontaminate.drop_leaks(none, items)):
        assert out.columns == docs.columns and out.collect() == []


def test_brown_tokenises_every_text_once(spark, tmp_path):
    from citegraph.llm import brown
    texts = [(1, "the cat the"), (2, None), (3, "Dog \x0b cat"), (4, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).selectExpr("string(doc_id) doc_id", "coalesce(text, '') text", "doc_id <> 3 train")
    block = brown.token_blocks(rows).toPandas()
    (_, ids, words, at, lengths), = brown.blocks_of([block, block], False)
    assert list(ids) == ["1", "2", "3", "4"] * 2 and lengths.tolist() == [3, 0, 2, 0] * 2
    assert words[at].tolist() == [brown.word_hash(w) for w in "the cat the dog cat".split() * 2]
    (_, _, words, at, lengths), = brown.blocks_of([block], False)
    assert words[at].tolist() == [brown.word_hash(w) for w in "the cat the dog cat".split()] and lengths.tolist() == [3, 0, 2, 0]
    (_, _, words, at, lengths), = brown.blocks_of([block], True)
    assert words[at].tolist() == [brown.word_hash(w) for w in "the cat the".split()] and lengths.tolist() == [3, 0, 0]
    # All passes after the first read blocks: of the input, one scan.
    scans = tmp_path / "scans"
    scans.mkdir()
    seen = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).mapInPandas(touched_in(str(scans)), "doc_id long, text string")
    assert brown.score_lm(seen).count() == 4
    assert len(list(scans.iterdir())) == 1


def touched_in(folder):
    def touched(frames):
        import tempfile
        tempfile.mkstemp(dir=folder)
        yield from frames
    return touched


def test_repeats_reads_and_cuts_texts_once(spark, tmp_path):
    scans = tmp_path / "scans"
    scans.mkdir()
    shared = "a passage that two documents share and that is longer than fifty bytes"
    rows = [(1, shared), (2, f"x{shared}y"), (3, None), (4, "short")]
    seen = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).mapInPandas(touched_in(str(scans)), "doc_id long, text string")
    out = repeats.remove_repeats(seen)
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: len(shared), 3: 0, 4: 0}
    # Two partitions, read for the total and for the blocks; blocks are cut in one place and removed from in another.
    assert len(list(scans.iterdir())) == 2 * 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 2


def slices_of(texts, width=repeats.LONGEST):
    rows = np.zeros((len(texts), width), np.uint8)
    for row, text in zip(rows, texts):
        row[:len(text)] = np.frombuffer(text, np.uint8)
    return rows, np.array([len(t) for t in texts])


def test_repeats_sorts_only_windows_of_several_slices(monkeypatch):
    sorted_bytes = []
    plainly = repeats.copies
    monkeypatch.setattr(repeats, "copies", lambda text, *rest: sorted_bytes.append(len(text)) or plainly(text, *rest))
    rng = random.Random(7)
    alone, one = ("".join(rng.choices("abcdef ", k=n)).encode() for n in (60, 70))
    # The same slice in four documents, two of one id, and a slice that nothing shares.
    rows, size = slices_of([one, alone, one, one, one])
    gone = repeats.windows_to_remove(np.array([5, 9, 5, 5, 5], np.uint64), np.array([3, 1, 2, 2, 8]), size, rows)
    assert gone.sum(1).tolist() == [21, 0, 0, 0, 21] and sum(sorted_bytes) == 0
    # Another slice holds its last 55 bytes, in a smaller document.
    rows, size = slices_of([one, b"+" + one[-55:], one])
    gone = repeats.windows_to_remove(np.array([5, 5, 5], np.uint64), np.array([3, 1, 2]), size, rows)
    assert [np.flatnonzero(g).tolist() for g in gone] == [list(range(21)), [], list(range(15, 21))] and sum(sorted_bytes) == 2 * 55


class Steps:
    """Stands for a DataFrame; keeps the functions of an operator's steps."""
    def __init__(self):
        self.found = []

    def groupBy(self, *names):
        return self

    def cogroup(self, other):
        return self

    def applyInPandas(self, function, schema):
        self.found.append(function)
        return self

    mapInPandas = applyInPandas


def repeats_in_steps(rows, parts):
    frame = pd.DataFrame({"doc_id": [str(i) for i, _ in rows], "place": [str(i) for i, _ in rows], "raw": [(t or "").encode() for _, t in rows]})
    steps = Steps()
    repeats.remove(repeats.blocked_texts(steps), repeats.answer_slices(repeats.cut_slices(steps, repeats.named_in_two(steps, parts, 64), parts)), False)
    blocked, local, named, cut, answered, removed = steps.found
    blocks = pd.concat(blocked(iter([frame])))
    each = [((k,), g) for k, g in blocks.groupby("block")]
    flags = pd.concat([named((k,), g) for k, g in pd.concat([local(*e) for e in each]).groupby("part")])
    state = pd.concat([cut(*e, flags[flags["block"] == e[0][0]]) for e in each])
    replies = pd.concat([answered(k, g) for k, g in state.groupby(["kind", "at"])])
    out = pd.concat([removed(*e, replies[replies["block"] == e[0][0]]) for e in each])
    return len(each), state, out


@pytest.mark.parametrize("wide", [1, 48])
def test_repeats_over_many_blocks_and_ranges(monkeypatch, wide):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    for name, value in (("BLOCK_BYTES", 9_000), ("PIECE", 700), ("SLICES", 40), ("CHUNK", 16), ("WIDE", wide), ("BATCH", 3_000)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(30)}" for _ in range(n))
    passages = [prose(rng.choice([8, 12, 30, 200])) for _ in range(25)]
    rows = [(i, " ".join(rng.choice([prose(rng.randrange(12)), rng.choice(passages), rng.choice(passages)[5:90], "z" * 70]) for _ in range(rng.randrange(9)))) for i in range(150)]
    rows += [(5, rows[5][1]), (6, rows[90][1]), (200, rows[90][1]), (201, None), (202, prose(40) + passages[0][:50]), (203, passages[0][:49])]
    blocks, state, out = repeats_in_steps(rows, 12)
    assert blocks > 3 and state["at"][state["kind"] == 2].nunique() > 6
    # What a block keeps for itself holds no text.
    assert (state["payload"][state["kind"] == 1].map(len) < 9_000).all()
    got = {}
    for i, *rest in out[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False):
        got.setdefault(int(i), []).append(tuple(rest))
    assert {i: sorted(v) for i, v in got.items()} == plain.repeats(rows)
