import hashlib
import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shoal.operators import annotations, catalog, forum, graph
from shoal.session import fresh_path
from shoal.sources import files, forum_tables, versions
from shoal.sources.stored import Stored

CAT = ("user_id string, dataset_id string, version string, name string, description string, tags array<string>, "
       "file_type string, created_at timestamp, public_link struct<dataset_id:string,version:string>, updated_at timestamp")


@pytest.fixture(scope="module")
def cat(spark):
    t = datetime.fromisoformat
    rows = [
        ("u", "d", "v1", "old name", "alpha", ["x"], "csv", t("2024-01-01"), None, t("2024-01-01")),
        ("u", "d", "v2", "new name", "beta", ["x", "y"], "csv", t("2024-02-01"), None, t("2024-02-01")),
        ("u", "d", "v10", "new name", "beta", ["y"], "csv", t("2024-02-01"), None, t("2024-02-01")),
        ("u", "d", "draft", "draft", None, None, "csv", t("2023-01-01"), None, t("2023-01-01")),
        ("u", "abc", "v1", "a", "gamma", [], "zip", t("2024-01-05"), None, t("2024-01-05")),
        ("u", "abcdef", "v1", "a", "gamma", [], "zip", t("2024-01-06"), ("p", "v1"), t("2024-01-06")),
        ("u", "my_values", "v1", "user_uploaded_dataset_7", "", [], "zip", t("2024-01-07"), None, t("2024-01-07")),
    ]
    return spark.createDataFrame(rows, CAT)


def ids(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_latest_takes_the_number(cat):
    got = dict(ids(catalog.latest_version(cat, ["user_id", "dataset_id"]), "dataset_id", "version"))
    assert got == {"d": "v10", "abc": "v1", "abcdef": "v1", "my_values": "v1"}


def test_search_filters_before_choosing(cat):
    assert ids(catalog.search_latest(cat, "u", query="ALPHA"), "dataset_id", "version") == [("d", "v1")]
    assert ids(catalog.search_latest(cat, "u", tags_any=["x"]), "version") == [("v2",)]


def test_versions(cat):
    assert ids(catalog.list_versions(cat, "u", "abc"), "dataset_id") == [("abc",)]
    assert ids(catalog.list_versions(cat, "u", "abc", prefix=True), "dataset_id") == [("abcdef",), ("abc",)]
    assert ids(catalog.list_versions(cat, "u", "my_values", prefix=True), "dataset_id") == [("my_values",)]
    got = catalog.next_versions(cat.where("dataset_id = 'd'"), 2)
    assert sorted(ids(got, "next_version")) == [("v11",), ("v12",)]
    only = catalog.next_versions(cat.where("version = 'draft'"), 1)
    assert ids(only, "next_version") == [("v1",)]
    assert ids(catalog.next_auto_name(cat), "next_name") == [("user_uploaded_dataset_8",)]


def test_linked_datasets_refuse_patches(cat, spark):
    patches = spark.createDataFrame(
        [("u", "d", "N", datetime.fromisoformat("2025-01-01")), ("u", "abcdef", "N", datetime.fromisoformat("2025-01-01"))],
        "user_id string, dataset_id string, name string, updated_at timestamp")
    out = catalog.update_all_versions(cat, patches)
    assert set(ids(out.where("patched"), "dataset_id", "name")) == {("d", "N")}
    assert out.count() == cat.count()


def test_deletion(cat, spark):
    doomed = spark.createDataFrame([("u", "d")], "user_id string, dataset_id string")
    kept = catalog.delete_versions(cat, doomed, "latest")
    assert sorted(ids(kept.where("dataset_id = 'd'"), "version")) == [("draft",), ("v1",), ("v2",)]
    assert catalog.delete_versions(cat, doomed, "all").where("dataset_id = 'd'").count() == 0
    assert ids(catalog.deletion_counts(cat, kept), "deleted") == [(1,)]


def test_upsert_keeps_creation_time(spark):
    t = datetime.fromisoformat
    schema = "k long, payload string, extra string, created_at timestamp, updated_at timestamp"
    table = spark.createDataFrame([(1, "a", "e", t("2024-01-01"), t("2024-01-01"))], schema)
    updates = spark.createDataFrame(
        [(1, "b", None, None, t("2024-03-01")), (1, "c", None, None, t("2024-02-01")),
         (2, "n", None, None, t("2024-02-02"))], schema)
    got = {r["k"]: r for r in catalog.upsert(table, updates, ["k"], keep_if_null=["extra"]).collect()}
    assert got[1]["payload"] == "b" and got[1]["extra"] == "e" and got[1]["created_at"] == t("2024-01-01")
    assert got[2]["created_at"] == t("2024-02-02")


def test_containment_join(spark):
    models = spark.createDataFrame([("m1", "xxabcxx"), ("m2", "abc"), ("m3", "ab"), ("m4", "abcabc")],
                                   "model_id string, training_dataset string")
    models = models.withColumn("version", F.lit("v1")).withColumn("created_at", F.lit(1))
    sets = spark.createDataFrame([("abc",), ("xx",), ("toolongforall",)], "dataset_id string")
    got = sorted(ids(catalog.models_for_dataset(models, sets), "model_id", "dataset_id"))
    assert got == [("m1", "abc"), ("m1", "xx"), ("m2", "abc"), ("m4", "abc")]
    assert ids(catalog.models_for_dataset(models, sets, exact=True), "model_id") == [("m2",)]


def test_user_files(spark):
    rows = spark.createDataFrame(
        [("../a b$.TXT", 5), ("x.exe", 5), ("big.csv", 30 * 1024 * 1024), ("noext", 1), ("", 1), ("é" * 300 + ".md", 1)],
        "original_filename string, size_bytes long")
    got = [tuple(r) for r in catalog.validate_user_files(rows).select("safe_name", "reason").collect()]
    assert got[0] == ("..a b.TXT", None) and got[1][1] == "file type not allowed" and got[2][1] == "file too large"
    assert got[3][1] == "file type not allowed" and got[4] == ("file", "filename is required")
    assert got[5][0] == "é" * 200


def test_robust_csv(spark):
    path = fresh_path(spark, "robust")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration())

    def put(name, data):
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(data))
        out.close()

    put("a.csv", "id,t,n\n1,café,2.5\n2,\"two\nlines\",3\n3,too,1,many\n4,short\n".encode())
    put("b.csv", "id,t,n\n5,crème,7\n".encode("latin-1"))
    got = {r["id"]: (r["t"], r["n"]) for r in files.read_csv_robust(spark, path).collect()}
    assert got == {1: ("café", 2.5), 2: ("two\nlines", 3.0), 4: ("short", None), 5: ("crème", 7.0)}
    traits = {r["path"][-5:]: (r["encoding"], r["multi_line"]) for r in files.file_traits(spark, path).collect()}
    assert traits == {"a.csv": ("UTF-8", True), "b.csv": ("ISO-8859-1", False)}
    inventory = {r["relative_path"]: r["file_type"] for r in files.file_inventory(spark, path).collect()}
    assert inventory == {"a.csv": "csv", "b.csv": "csv"}
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("__MACOSX/x.csv", "no")
        z.writestr("data/First.CSV", "a,b\n1,x\n2,y,z\n3\n")
        z.writestr("second.csv", "c\n1\n")
    put("zips/one.zip", blob.getvalue())
    put("zips/two.csv", b"a,b\n9,q\n")
    got = sorted(tuple(r) for r in files.read_zipped_csv(spark, path + "/zips").select("a", F.coalesce("b", F.lit("-"))).collect())
    assert got == [(1, "x"), (3, "-"), (9, "q")]
    put("n/names.arff", b"% note\n@attribute state numeric\n@ATTRIBUTE name {a, b}\n")
    names = files.read_attribute_names(spark, path + "/n").orderBy("position").collect()
    assert [r["name"] for r in names] == ["state", "name"]


def test_versions_are_not_overwritten(spark):
    root = fresh_path(spark, "store")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("test"))
    versions.write_version(df, root, "u", "d", "v1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        versions.write_version(df, root, "u", "d", "v1")
    part = versions.read_split(spark, root, "u", "d", "v1", "test")
    assert part.count() == 3 and "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()


def test_export_import_round_trip(spark):
    rows = [(1, 10, 5, 1, datetime.fromisoformat("2024-01-01 10:00:00"), None), (2, None, 6, -1, None, None)]
    votes = spark.createDataFrame(rows, "vote_id long, expert_id long, answer_id long, vote_value long, "
                                        "created_at timestamp, updated_at timestamp")
    sheet = forum_tables.export_table(votes, "Votes")
    assert [r["Vote Type"] for r in sheet.collect()] == ["Upvote", "Downvote"]
    back = forum_tables.import_table(sheet, "Votes")
    got = [tuple(r) for r in back.select("vote_id", "expert_id", "answer_id", "vote_value", "created_at").collect()]
    assert got == [(1, 10, 5, 1, "2024-01-01 10:00:00"), (2, None, 6, -1, None)]


def test_annotations(spark):
    listed = spark.createDataFrame(
        [("./a/one.JPG",), ("b/two.png",), ("c/two.png",), ("annotations.csv",), ("readme.txt",)], "relative_path string")
    ann = spark.createDataFrame(
        [("a/one.JPG", "x"), ("TWO.png", "y"), ("One.jpg", "z"), ("gone.png", "w"), (".\\b\\two.png", " ")],
        "Image_Path string, Class string")
    rows = annotations.normalize_annotations(ann)
    got = {r["filename"]: r["matched_path"] for r in annotations.match_annotations(listed, rows).collect()}
    assert got == {"a/one.JPG": "a/one.JPG", "TWO.png": None, "One.jpg": "a/one.JPG", "gone.png": None,
                   ".\\b\\two.png": "b/two.png"}
    assert annotations.validate_annotations(listed, ann).first()["valid"]
    assert annotations.validate_annotations(listed, ann.limit(1).toDF("who", "Class")).first()["reason"] \
        == "no file name or label column"
    none = listed.where("relative_path <> 'annotations.csv'")
    assert annotations.validate_annotations(none, None).first()["reason"] == "missing annotations file"
    placed = annotations.split_annotations(listed, ann).collect()
    assert {r["label"] for r in placed} == {"x", "z"}
    texts = spark.createDataFrame([('{"annotations": [{"Image": "a.png", "y": "1"}]}',), ('[{"path": "b.png", "label": "2"}]',)],
                                  "value string")
    assert sorted((r["filename"], r["label"], r["fields"]) for r in annotations.annotations_from_json(texts).collect()) == [
        ("a.png", "1", {"Image": "a.png", "y": "1"}), ("b.png", "2", {"path": "b.png", "label": "2"})]


def test_archives_are_streams(spark, tmp_path):
    def archive(name, text, encoding="utf-8"):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as out:
            out.writestr("__MACOSX/x.csv", "no,no")
            out.writestr("in/data.csv", text.encode(encoding))
    archive("a.zip", 'näme,n\n"two\nlines, ü",1\nshort\n1,2,3\n\n,4\n')
    archive("b.zip", "n,other,n\n5,é,6\n", "latin-1")
    (tmp_path / "plain.csv").write_text("n\n7\n")
    archive("long.zip", "n,text\n" + "".join(f"{i},{'x' * 900}\n" for i in range(5000)))
    archive("none.zip", "")
    got = files.read_zipped_csv(spark, str(tmp_path))
    assert got.columns == ["n", "other", "text", "näme"] and got.schema["n"].dataType.simpleString() == "bigint"
    few = got.where("text is null").select("näme", "n", "other").collect()
    assert sorted(map(tuple, few), key=str) == sorted(
        [("two\nlines, ü", 1, None), ("short", None, None), (None, 4, None), (None, 5, "é"), (None, 7, None)], key=str)
    assert got.where("length(text) = 900").agg(F.sum("n")).first()[0] == 5000 * 4999 // 2
    plan = files.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    digests = {r["relative_path"]: (r["file_size"], r["file_hash"]) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert digests == {p.name: (p.stat().st_size, hashlib.md5(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    (tmp_path / "bad.zip").write_bytes((tmp_path / "a.zip").read_bytes()[:40])
    with pytest.raises(Exception, match="zip|Zip"):
        files.read_zipped_csv(spark, str(tmp_path / "bad.zip"))


def test_stored_upserts(spark, tmp_path):
    schema = "user_id long, name string, n long, created_at long, updated_at long"
    store = Stored(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        store.read()
    store.create(spark.createDataFrame([(i, f"u'{i}", 0, 1, 1) for i in range(200)], schema), ["user_id", "name"], buckets=32)
    with pytest.raises(ValueError):
        store.create(store.read(), ["user_id", "name"])

    def change(*rows):
        return spark.createDataFrame([(i, f"u'{i}", n, at, at) for i, n, at in rows], schema)

    def values():
        return {r["user_id"]: r["n"] for r in store.read().collect()}

    def files():
        return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}

    first, before = store.version(), files()
    assert store.upsert(change((3, 30, 5))) == 2 and values()[3] == 30 and len(values()) == 200
    now = store.version()
    assert sum(now.folders[b] != first.folders[b] for b in first.folders) == 1 and before.items() <= files().items()
    assert {r["n"] for r in store.read(1).collect()} == {0}
    # another writer comes first, with other rows, with a row of the same partition, and with the very same row
    for mine, other in (((4, 40, 6), (5, 50, 6)), ((4, 41, 7), (4, 42, 8)), ((300, 1, 9), (301, 2, 9))):
        waiting = [lambda: store.upsert(change(other))]
        store.upsert(change(mine), before_commit=lambda: waiting and waiting.pop()())
    assert values() | {3: 30, 4: 41, 5: 50, 300: 1, 301: 2} == values() and len(values()) == 202
    assert [r["n"] for r in store.find(user_id=5, name="u'5").collect()] == [50] and store.find(user_id=5, name="x").count() == 0
    number = store.version().number
    assert store.upsert(change().limit(0)) == number


def test_threads_and_references(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99)], "answer_id long, parent_id long")
    got = {r["answer_id"]: (r["root_id"], r["depth"]) for r in forum.answer_threads(rows).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0)}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "answer_id long, parent_id long")
    with pytest.raises(ValueError):
        forum.answer_threads(loop, max_rounds=5)


def test_patterns_must_be_connected(spark):
    triples = spark.createDataFrame([("a", "p", "b"), ("b", "p", "b")], "s string, p string, o string")
    assert [tuple(r) for r in graph.match_pattern(triples, [("?x", "p", "?x")]).collect()] == [("b",)]
    with pytest.raises(ValueError):
        graph.match_pattern(triples, [("?x", "p", "?y"), ("?z", "p", "b")])


def test_upload_events_prefer_the_split(spark):
    from shoal import schemas
    from shoal.streaming import events as flow

    split = {"split": {"train": 7, "test": 1, "drift": 2}, "is_mitigated": False, "file_count": 2}
    when = datetime.fromisoformat("2024-01-01")
    rows = [{"user_id": "u", "dataset_id": "d", "version": "v1", "created_at": when, "files": None},
            {"user_id": "u", "dataset_id": "d", "version": "v2", "created_at": when, "custom_metadata": split,
             "files": [{"filename": "a"}, {"filename": "b"}]},
            {"user_id": "u", "dataset_id": "e", "version": "v1", "created_at": when}]
    cat = spark.createDataFrame(rows, schemas.CATALOG_DATASET)
    got = sorted(ids(flow.dataset_events(cat, F.lit("2024-05-01").cast("timestamp")), "key", "version", "file_count"))
    assert got == [("d", "v2", 2), ("e", "v1", 1)]
    assert catalog.duplicate_keys(cat, schemas.KEYS["catalog_dataset"]).isEmpty()
    assert ids(catalog.duplicate_keys(cat, ["user_id", "dataset_id"]), "dataset_id", "copies") == [("d", 2)]
    for ddl in (schemas.CATALOG_MODEL, schemas.REPORT_XAI, schemas.USER_FILE, *schemas.FORUM.values()):
        assert spark.createDataFrame([], ddl).isEmpty()


def test_references_are_checked_without_sorting_the_rows_of_an_id(spark, capsys):
    experts = spark.createDataFrame([(1,), (2,)], "expert_id long")
    themes = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "theme_id long, expert_id long")
    questions = spark.createDataFrame([(1, 1), (2, 7), (2, 7)], "question_id long, theme_id long")
    answers = spark.createDataFrame([(1, 1, None), (2, 5, 1), (3, 1, 8), (3, 1, 8)], "answer_id long, question_id long, parent_id long")
    votes = spark.createDataFrame([(f"v{i}", 1 if i else 4, 3) for i in range(50)] + [("w", None, 6)],
                                  "vote_id string, expert_id long, answer_id long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = forum.check_references(themes, questions, answers, votes, experts)
        got = sorted(tuple(r) for r in found.collect())
        found.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [("answer", "2", "question_id", "5"), ("answer", "3", "parent_id", "8"), ("answer", "3", "parent_id", "8"),
                   ("question", "2", "theme_id", "7"), ("question", "2", "theme_id", "7"), ("theme", "2", "expert_id", "9"),
                   ("vote", "v0", "expert_id", "4"), ("vote", "w", "answer_id", "6")]
    final = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin") <= 1 and final.count("ShuffledHashJoin") == 5  # themes are a short list


def test_bulk_json_parses_an_object_only_for_the_entities_it_names(spark, capsys):
    rows = [('{"Expert": [{"id": 1, "bio": "a Vote"}], "Vote": [{"id": 2, "expert_id": 1}]}',), ("{'Vote': [{'id': 3}]}",),
            ('{"V\\u006fte": [{"id": 4}]}',), ('{"Theme": [{"id": 5, "name": "x"}]}',), ("no object of a Vote",), (None,)]
    made = forum_tables.import_json_bulk(spark.createDataFrame(rows, "value string"), as_of=datetime(2024, 1, 1))
    assert sorted(r["vote_id"] for r in made["Vote"].collect()) == [2, 3, 4]
    assert [r["expert_id"] for r in made["Expert"].collect()] == [1] and [r["theme_id"] for r in made["Theme"].collect()] == [5]
    made["Vote"].explain()
    assert "Contains" in capsys.readouterr().out.title()
