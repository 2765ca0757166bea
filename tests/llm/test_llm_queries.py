"""Registered queries against their SQL, or against brute force where SQL cannot express them."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
from oracle import compare, connect

import corpus_pipeline
from shoal.llm import bpe
from shoal.llm.queries import ORACLES, QUERIES, RANKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").df()


def rows(spark, name):
    return QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    result, expected = rows(spark, name), con.execute(ORACLES[name]).df()
    for frame in (result, expected):
        for column in {"refers_to", "parent_conv_id"} & set(frame):  # ids with nulls: pandas has several types for them
            frame[column] = frame[column].astype("Int64")
    assert compare(result, expected) is None


def tokenizer():
    codec = bpe.Codec(bpe.read_ranks(RANKS), ".")
    import public_tokenizers
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_op1(spark, docs):
    found, enc = rows(spark, "op1_byte_bpe").set_index("doc_id"), tokenizer()
    assert len(found) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        ids = enc.encode_ordinary(text)
        assert tuple(found.loc[i][["n_tokens", "ids_sha256", "decoded_sha256"]]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def base_spans(text):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                                   re.I | re.A), 2, 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    spans = sorted((m.start(), n, m.end(), kind) for n, (kind, pattern, group, least) in enumerate(kinds)
                   for m in pattern.finditer(text or "") if len(m.group(group)) >= least)
    return [f"{kind}:{a}:{b}" for a, _, b, kind in spans]


def test_op2(spark, docs):
    found = rows(spark, "op2_secret_scan").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        spans = base_spans(text)
        assert found.loc[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(found.loc[i].spans.split(","))
        assert found.loc[i].n_assign == sum(x.startswith("assign") for x in spans)


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op4(spark, con):
    found = rows(spark, "op4_quality").merge(con.execute("SELECT * FROM labels").df(), on="doc_id")
    assert (found.held_out == found.doc_id.map(is_held_out)).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    held = found[found.held_out]
    good, bad = (held[held.quality == k].score.to_numpy() for k in (1, 0))
    assert np.mean(good[:, None] > bad) > 0.9 if len(bad) else True
    assert (held.predicted == held.quality).mean() > 0.9


def test_op6(spark, docs):
    found = rows(spark, "op6_language").merge(docs, on="doc_id")
    assert len(found) == len(docs) and found.score.between(0, 1).all()
    held = found[found.held_out]
    assert (held.held_out == held.doc_id.map(is_held_out)).all() and (held.lang_pred == held.lang).mean() > 0.95


def removed_by_brute_force(texts, length):
    places = {}
    data = [(t or "").encode() for t in texts]
    for k, text in enumerate(data):
        for i in range(len(text) - length + 1):
            places.setdefault(text[i:i + length], []).append((k, i))
    marks = [np.zeros(len(x), bool) for x in data]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                marks[k][i:i + length] = True
    return data, marks


def test_op9(spark, docs):
    found = rows(spark, "op9_suffix_dedup").set_index("doc_id")
    assert found.n_removed.sum() > 0
    for i, text, mark in zip(docs.doc_id, *removed_by_brute_force(docs.text, 400)):
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        rest = np.frombuffer(text, np.uint8)[~mark].tobytes()
        assert tuple(found.loc[i]) == (len(text), int(mark.sum()), spans, hashlib.sha256(rest).hexdigest())


def test_pipeline_stages(spark, con, docs):
    """Each stage against brute force on its own input."""
    before = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], before.columns
    assert names == ["quality classifier", "near duplicates", "benchmark decontamination", "secret scans", "byte-level BPE"]
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = before.toPandas()
        after = stage(spark, before, SF)
        if name != names[-1]:
            assert after.columns == columns
        before = spark.createDataFrame(after.toPandas(), after.schema)
    inputs["out"] = before.toPandas()
    kept = [set(inputs[n].doc_id) for n in (*names, "out")]
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[3] == kept[4] == kept[5]
    labels = con.execute("SELECT doc_id, quality FROM labels").df().set_index("doc_id").quality
    wrong = [i for i in labels.index if (labels[i] == 1) != (i in kept[1])]
    assert len(wrong) <= 0.05 * len(labels)

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets = {i: shingles(t) for i, t in zip(inputs[names[1]].doc_id, inputs[names[1]].text)}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept[2] == {i for i in ids if find(i) == i}
    flags = con.execute(f"SELECT doc_id, contaminated FROM ({ORACLES['op7_decontamination']})").df().set_index("doc_id").contaminated
    assert kept[3] == {i for i in kept[2] if not flags[i]}
    for before, after in zip(*(inputs[n].sort_values("doc_id").itertuples() for n in names[3:])):
        assert not base_spans(after.text) and (after.text == before.text or base_spans(before.text))
        assert after.n_chars == len(after.text)
    enc = tokenizer()
    texts = inputs[names[4]].set_index("doc_id").text
    for row in inputs["out"].itertuples():
        assert np.frombuffer(row.ids, "<u4").tolist() == enc.encode_ordinary(texts[row.doc_id])
