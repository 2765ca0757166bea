"""Merkle manifest, sharding and prefix trie against plain versions; nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shoal.llm import merkle, sharding, trie
from shoal.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- Merkle manifest

def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    """(place, sibling) of every level; a node without sibling gives (None, None)."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((None, None) if other >= len(level) else ("L" if other < i else "R", level[other]))
        i >>= 1
    return out


@pytest.mark.parametrize("n", [*range(1, 36), 255, 256, 257])
def test_log_and_addresses(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    log = [x.hex() for x in merkle.build_log([bytes.fromhex(x) for x in leaves], merkle.height(n))]
    places = {merkle.position(k, i, n): x for k, level in enumerate(levels) for i, x in enumerate(level)}
    assert [places[i] for i in range(len(places))] == log and len(levels) == merkle.height(n) + 1
    for i in range(n):
        path = merkle.path_in([bytes.fromhex(x) for x in log], i, n, merkle.height(n))
        assert merkle.fold(bytes.fromhex(leaves[i]), path).hex() == levels[-1][0]
        assert merkle.siblings(path).hex() == h(*(x for _, x in plain_path(levels, i) if x))


def plain_audit(rows):
    """From (doc_id, text, lang, source, n_chars): sorted tuples of all columns."""
    def leaf(i, text, lang, source, n):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0], leaf(*row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for members in trees.values():
        members.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {k: plain_levels([x[1] for x in trees[k]]) for k in names}
    upper = plain_levels([built[k][-1][0] for k in names])
    out = []
    for number, k in enumerate(names):
        for i, (doc_id, digest, row) in enumerate(trees[k]):
            path = plain_path(built[k], i) + plain_path(upper, number)
            now = digest
            if doc_id is not None and row[4] is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                now = leaf(*row[:4], row[4] + 1)
            for side, sibling in path:
                now = h(now) if side is None else h(sibling, now) if side == "L" else h(now, sibling)
            out.append((doc_id, digest, built[k][-1][0], upper[-1][0], h(*(x for _, x in path if x)), now, now == upper[-1][0]))
    return sorted(out, key=str)


def audited(spark, rows):
    clash = ", ".join(f"{c} string" for c in ("tree", "id", "number", "digest", "found", "place", "block", "root", "path", "log"))
    docs = spark.createDataFrame([(*r, *"abcdefghij") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clash)
    from pyspark.sql import functions as F
    return sorted(map(tuple, merkle.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()), key=str)


def test_audit_equals_plain(spark):
    rng = random.Random(3)
    langs = ["en"] * 40 + ["de", "fr", "é", "", None]
    rows = [(i, f"text {i}", rng.choice(langs), "s", 5 + i) for i in range(700)]
    rows += [(7, "again", "en", None, None), (7, "again", "en", None, None), (None, None, None, None, None), (None, "", "en", "", 0),
             (9000, "x" * 200000, "alone", "s", 1 << 62), (9001, "ü\n", "zz", "s", (1 << 63) - 1)]
    got = audited(spark, rows)
    assert got == plain_audit(rows)
    assert not all(x[-1] for x in got) and sum(x[-1] for x in got) > 500


def test_audit_of_little(spark):
    assert audited(spark, []) == []
    one = [(1, "a", "en", "s", 1)]
    assert audited(spark, one) == plain_audit(one) and audited(spark, one)[0][3] == audited(spark, one)[0][1]


# ---- sharding

@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (0, 3, 2), (3, 0, 2), (1, 1, 2), (40, 25, 30), (2, 90, 50), (6, 6, 0)])
def test_hypergeometric(good, bad, draws):
    grid = 20000
    seen = Counter(sharding.hypergeometric((i + 0.5) / grid, good, bad, draws) for i in range(grid))
    for k in range(good + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) if 0 <= draws - k <= bad else 0
        assert abs(seen[k] / grid - p) < 2e-4


def test_hypergeometric_of_large_numbers():
    rng = np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(u, 10**11, 7 * 10**11, 4 * 10**11) for u in rng.random(300)])
    sd = math.sqrt(4e11 * (1 / 8) * (7 / 8) * 0.5)
    assert abs(x.mean() - 5e10) < 5 * sd / math.sqrt(300) and 0.8 < x.std() / sd < 1.2


def test_matrix_margins_and_law():
    for sizes, shards in (([5, 0, 9, 1, 30], 4), ([3], 8), ([], 3), ([100] * 33, 7)):
        matrix = sharding.Matrix(sizes, shards, 4)
        rows = [matrix.row(b) for b in range(len(sizes))]
        assert [sum(r) for r in rows] == sizes and max(matrix.shards) - min(matrix.shards) <= 1
        assert [sum(c) for c in zip(*rows)] == (matrix.shards if rows else [])
    seen = Counter(tuple(sharding.Matrix([2, 3, 2], 2, s).row(b) for b in range(3)) for s in range(6000))
    law = Counter(tuple((2 - sum(x[a:b]) if b - a == 2 else 3 - sum(x[a:b]), sum(x[a:b])) for a, b in ((0, 2), (2, 5), (5, 7)))
                  for x in itertools.product((0, 1), repeat=7) if sum(x) == 3)
    assert set(seen) == set(law)
    for k, n in law.items():
        p = n / 35
        assert abs(seen[k] / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000)


def check_placed(rows, n, shards):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts[k] for k in range(shards)]
    assert len(rows) == n and max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_shards(spark, tmp_path):
    rows = [(i % 200 if i % 9 else None, None if i % 11 == 0 else "x" * (i % 5), "shard", "slot", i) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SHARD string, Slot string, page long").repartition(5)
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    one = sharding.write_shards(docs, f"{tmp_path}/one", 8, 1).collect()
    check_placed(one, 1003, 8)
    assert Counter((r["doc_id"], r["text"], r["page"]) for r in one) == Counter((r[0], r[1], r[4]) for r in rows)
    assert len([p for p in (tmp_path / "one").iterdir() if p.name.startswith("shard=")]) == 8
    assert sorted(sharding.write_shards(docs, f"{tmp_path}/two", 8, 1).collect(), key=str) == sorted(one, key=str)
    other = sharding.write_shards(docs, f"{tmp_path}/three", 8, 2).collect()
    assert sum(a["shard"] == b["shard"] for a, b in zip(sorted(one, key=lambda r: r["page"]), sorted(other, key=lambda r: r["page"]))) < 250
    check_placed(sharding.write_shards(docs.limit(3), f"{tmp_path}/few", 8).collect(), 3, 8)
    assert sharding.write_shards(docs.where("page < 0"), f"{tmp_path}/none", 8).collect() == []


def test_shards_by_hand(spark, tmp_path):
    """The same shards and slots from the draws alone, without Spark."""
    spark.range(500).selectExpr("id AS doc_id", "string(id) AS text").repartition(3, "doc_id").write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    from pyspark.sql import functions as F
    places = {r[0]: r[1] for r in docs.select("doc_id", F.monotonically_increasing_id()).collect()}
    blocks = Counter(p // sharding.BLOCK for p in places.values())
    labels = sharding.Labels(np.array(list(blocks)), np.array(list(blocks.values())), 4, 7)
    want, by_shard = {}, {}
    for doc, place in places.items():
        shard, rank = labels(np.array([place]))
        by_shard.setdefault(int(shard[0]), []).append((int(rank[0]), place, doc))
    for shard, members in by_shard.items():
        want |= {doc: (shard, slot) for slot, (_, _, doc) in enumerate(sorted(members))}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.write_shards(docs, f"{tmp_path}/out", 4, 7).collect()} == want


def test_op12(spark):
    rows = QUERIES["op12_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_placed(rows, len(docs), 8)
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {
        (i, len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in docs.items()}


# ---- prefix trie

def plain_trie(seqs):
    """Rows of the trie of {conversation: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, s in seqs.items():
        ends.setdefault(tuple(s), []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, found in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(found) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(c), len(k), min(members[k[:-1]]) if k else None, len(c), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, c in members.items())


def trie_rows(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                  for r in df.collect())


def conversations(spark, seqs):
    rows = [(c, t, role, text, "x", "y") for c, s in seqs.items() for t, (role, text) in enumerate(s)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, units string, seq string")


def family(rng, n, depth, words):
    return {i * 37 - 50: [("ua"[t % 2], rng.choice(words)) for t in range(rng.randint(1, depth))] for i in range(n)}


@pytest.mark.parametrize("seed,n,depth,words,limit,fan", [
    (1, 120, 7, 2, 1 << 18, 32), (2, 300, 6, 2, 100, 2), (3, 200, 12, 1, 60, 2), (4, 150, 5, 3, 400, 3), (5, 40, 60, 1, 1, 2)])
def test_trie_equals_plain(spark, seed, n, depth, words, limit, fan):
    rng = random.Random(seed)
    seqs = family(rng, n, depth, ["a", "bé", "", "longer text"][:words] if words < 3 else ["a", "bé", ""])
    seqs |= {10**12 + i: [("u", "a"), ("a", "a"), ("u", "a"), ("a", str(i % 3))] for i in range(60)}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = trie_rows(trie.prefix_trie(trie.sequences(conversations(spark, seqs)), limit, fan))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_trie(seqs)


@pytest.mark.parametrize("seed", range(40))
def test_forests_equal_plain(seed):
    """Slices, contraction and joins of any cut of the sorted sequences."""
    rng = random.Random(seed)
    seqs = family(rng, rng.randint(1, 40), rng.randint(1, 9), ["a", "b", "c"][:rng.randint(1, 3)])
    def unit(role, text):
        return hashlib.sha256(f"{role}{text}".encode()).digest()[:16] + len(text).to_bytes(4, "big")
    classes = {}
    for c, s in seqs.items():
        classes.setdefault(b"".join(unit(*t) for t in s), []).append(c)
    items = [trie.Chain(u, {len(u) // trie.UNIT: trie.Cell(len(c), min(c), ends=str(sorted(c)))}) for u, c in sorted(classes.items())]
    rows, forests = [], []
    while items:
        take = rng.randint(1, 6)
        part, items = items[:take], items[take:]
        forest = trie.Forest(False)
        forests.append(forest.join(part, [trie.common_prefix(a.units, b.units) for a, b in zip(part, part[1:])], False))
        rows += forest.rows
    while True:
        groups, forests = [forests[i:i + 2] for i in range(0, len(forests), 2)], []
        for group in groups:
            chains = [c for x, _ in group for c in x]
            links = []
            for k, (x, link) in enumerate(group):
                links += [trie.common_prefix(group[k - 1][0][-1].units, x[0].units)] if k else []
                links += [link] if len(x) == 2 else []
            forest = trie.Forest(True)
            forests.append(forest.join(chains, links, len(groups) == 1))
            rows += forest.rows
        if len(groups) == 1:
            break
    known = {r[0]: r[3] for r in rows if r[0]}
    for r in rows:
        if r[1]:
            r[2] = known[r[1]]
    got = sorted((r[3], r[4], r[2], *r[5:9]) for r in rows)
    assert got == [x[:7] for x in plain_trie(seqs)]


def test_sequences_and_heads(spark):
    rows = [(0, 1, "u", "b0"), (0, None, "u", "first"), (0, 0, None, "a0"), (0, 2, "a", None), (0, 2, "a", "tie"), (1, 0, "u", "own"),
            (None, 0, "u", "nobody"), (7, 0, "u", "no base"), (7, 1, "u", "x"), (-3, 5, "", "neg"), (-3, 5, "", "neg")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, unit string")
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, h(f"{len(role)}:", role, text)[:32], (role, text)))
    own = {c: [x[-1] for x in sorted(s)] for c, s in own.items()}
    rebuilt = {}
    for c, s in own.items():
        k = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(int(c - math.fmod(c, 5)), [])[:k] + s[k:]
    assert trie_rows(trie.prefix_trie(trie.with_common_heads(trie.sequences(df)))) == plain_trie(rebuilt)
    assert any(not s for s in rebuilt.values())
    assert trie_rows(trie.prefix_trie(trie.with_common_heads(trie.sequences(df.limit(0))))) == []
