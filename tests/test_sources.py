import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shelfmatch.operators import joins as J
from shelfmatch.sources import readers, reports, tables


def test_manifest_csv_lines_and_problems(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "﻿item_id, slug,image_uri,note\n1,a,/data/1.jpg,x\n\n , ,,\n2,\"b\nc\",/data/2.jpg\n3,,/data/3.jpg,\n4,d,/data/4.jpg,y,z\n5,\"e\"\"q\",/data/5.jpg,\n",
        encoding="utf-8")
    good, bad = readers.read_manifest_csv(spark, str(path), ["item_id", "slug", "image_uri"])
    assert [tuple(r) for r in good.orderBy("line").collect()] == [
        (2, "1", "a", "/data/1.jpg"), (6, "2", "b\nc", "/data/2.jpg"), (9, "5", 'e"q', "/data/5.jpg")]
    assert [tuple(r) for r in bad.orderBy("line").collect()] == [(7, "empty slug"), (8, "5 values for 4 columns")]
    with pytest.raises(ValueError, match="missing required"):
        readers.read_manifest_csv(spark, str(path), ["nope"])


def test_manifest_lines_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    rows = [f'{i},"s{i}' + ("\nmore" if i % 7 == 0 else "") + f'",/d/{i}' for i in range(4000)]
    path.write_text("a,b,c\n" + "\n".join(rows) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        good, bad = readers.read_manifest_csv(spark, str(path), ["a", "b", "c"])
        got = {int(r["a"]): r["line"] for r in good.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    line, want = 1, {}
    for i in range(4000):
        line += 2 if i % 7 == 0 else 1
        want[i] = line
    assert got == want and bad.count() == 0


def test_stray_and_unclosed_quotes_read_as_the_csv_module_reads_them(spark):
    import csv
    import random

    from shelfmatch.sources.csv_records import cells, records

    draw = random.Random(3)
    files = {"pan": 'a,b\n1,12" pan\n2,"x"y,z\n3,"p""q"\n4,q"uo"te\n', "open": 'a,b\n1,x\n2,"never\nclosed\n3,y\n'}
    for n in range(40):
        files[f"r{n}"] = "".join(draw.choice(['"', '""', ",", "a", "b c", "\n"]) for _ in range(60))
    lines = [(f, i, line) for f, text in files.items() for i, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None], 1)]
    found = records(spark.createDataFrame(lines, "file string, line long, value string")).withColumn("cells", cells(F.col("value"))).collect()
    for name, text in files.items():
        got = [r for r in sorted((r for r in found if r["file"] == name), key=lambda r: r["start_line"])]
        state, want = csv.reader([line + "\n" for line in text.split("\n")[: -1 if text.endswith("\n") else None]]), []
        for row in state:
            want.append((state.line_num, row))
        closed = [(r["line"], r["cells"]) for r in got if not r["unclosed"] and r["value"] != ""]
        whole = [(n, row) for n, row in want if row]
        if any(r["unclosed"] for r in got):
            whole = whole[:-1]
        assert closed == whole, (name, text)
        assert sum(r["unclosed"] for r in got) <= 1
    assert [r["start_line"] for r in found if r["file"] == "open" and r["unclosed"]] == [3]


def test_catalog_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Название вина,SLUG,Фото,Extra\n Мерло ,m,1.jpg,e,more,x\n\n,n,,\nТри,\"o\",3.jpg\n", encoding="utf-8")
    rows = readers.read_catalog_csv(spark, str(path), "file:c").orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["name"], r["slug"], r["dataset_photo"]) for r in rows] == [
        (2, "Мерло", "m", "1.jpg"), (3, None, "n", None), (4, "Три", "o", "3.jpg")]
    assert rows[0]["source_data"]["Название вина"] == " Мерло " and json.loads(rows[0]["source_data"]["_extra_columns"]) == ["more", "x"]
    assert rows[2]["source_data"]["Extra"] is None
    with pytest.raises(ValueError, match="dataset_photo"):
        readers.resolve_aliases(["slug", "name"])


def test_jsonl(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    row = lambda **k: json.dumps({"sample_id": "a", "image": "i", "series_id": "s", "split": "test", **k})
    path.write_text("\n".join([row(), row(sample_id="b"), row(sample_id="b"), row(sample_id="x/y"), row(sample_id="c", split=""), "{broken"]))
    good, bad = readers.read_jsonl(
        spark, str(path), readers.BENCHMARK_SCHEMA, ["sample_id", "image", "series_id", "split"], "sample_id", safe_name=True)
    assert [r["sample_id"] for r in good.collect()] == ["a"]
    assert sorted(r["problem"] for r in bad.collect()) == [
        "missing split", "not a JSON object of this schema", "repeated key", "repeated key", "unsafe name"]


def test_image_tree_and_snapshot(spark, tmp_path):
    for name in ("top.JPG", "wine/1.png", "wine/.hidden.png", ".dot/1.png", "wine/deep/2.png", "wine/read.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = sorted((r["item_id"], r["image_uri"]) for r in readers.scan_image_tree(spark, str(tmp_path)).collect())
    assert got == [("top", f"{tmp_path}/top.JPG"), ("wine", f"{tmp_path}/wine/1.png")]
    plan = readers.scan_image_tree(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    files = {r["file"]: r["bytes"] for r in tables.file_manifest(spark, str(tmp_path)).collect()}
    assert files["wine/read.txt"] == 13


def test_truth_and_review_run(spark, tmp_path):
    truth_file = tmp_path / "truth.txt"
    truth_file.write_text('image1: { name: "Мерло", years: "2019, 2020", other: "a,, b" }\nimage2: {\n name: "X", other: "" }\nimage3: { name: "Y" }')
    truth, bad = readers.read_truth_file(spark, str(truth_file))
    assert [(r["image_no"], r["name"], r["years"], r["other"]) for r in truth.orderBy("image_no").collect()] == [
        (1, "Мерло", ["2019", "2020"], ["a", "b"]), (2, "X", [], [])]
    assert bad.first()["problem"] == "entry needs name and other"
    run = tmp_path / "run"
    run.mkdir()
    (run / "manifest.json").write_text(json.dumps({"images": [
        {"image": "image1.jpg", "source": "a", "elapsed_seconds": 2.0}, {"image": "image9.jpg", "source": "b"}, {"image": "odd.jpg", "source": "c"}]}))
    (run / "image1_output.json").write_text(json.dumps({"result": {"normalized_text": "мерло 2019", "candidate_name": "Мерло", "text_blocks": [], "candidate_fields": []}}, indent=1))
    good, problems = readers.read_review_run(spark, str(run), truth)
    assert [r["candidate_name"] for r in good.collect()] == ["Мерло"]
    assert sorted((r["subject"], r["problem"]) for r in problems.collect()) == [
        ("image2", "truth without image"), ("image9.jpg", "missing result"), ("image9.jpg", "missing truth"), ("odd.jpg", "unexpected image name")]


def test_versioned_tables(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root, "t")
    assert tables.write_table(spark.range(3), root, "t") == 1
    again = tables.read_table(spark, root, "t").withColumn("id", F.col("id") + 1)
    assert tables.write_table(again, root, "t") == 2
    assert sorted(r["id"] for r in tables.read_table(spark, root, "t").collect()) == [1, 2, 3]


def test_photo_manifest_round_trip(spark, tmp_path):
    names = spark.createDataFrame([("Вино А.jpg",), ("b.png",), ("none.png",), ("c.jpg",)], "dataset_photo string")
    files = spark.createDataFrame([
        ("x/vino_a_0123456789.jpg",), ("x/b_aaaaaaaaaa.png",), ("y/b.png",), ("y/b.webp",), ("thumbnail_none.png",), ("z/c.png",), ("z/c.txt",)],
        "relative_path string")
    manifest, candidates = J.match_photo_names(names, files)
    got = {r["dataset_photo"]: (r["status"], r["candidate_count"], r["relative_path"]) for r in manifest.collect()}
    assert got == {
        "Вино А.jpg": ("matched", 1, "x/vino_a_0123456789.jpg"), "b.png": ("ambiguous", 2, ""), "none.png": ("missing", 0, ""),
        "c.jpg": ("matched", 1, "z/c.png")}
    assert sorted(r["relative_path"] for r in candidates.collect()) == ["x/b_aaaaaaaaaa.png", "y/b.png"]
    path = str(tmp_path / "manifest")
    tables.write_manifest_csv(manifest, candidates, path)
    assert readers.read_matched_manifest(spark, path).count() == 2
    staged = tables.stage_paths(manifest, candidates)
    sizes = files.withColumn("length", F.lit(10))
    assert tables.stage_summary(staged, sizes).first().asDict() == {"files": 4, "bytes": 40, "missing": 0}


def test_export_and_reports(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n123456"
    samples = spark.createDataFrame([(png,)], "image_bytes binary").withColumn("image_sha256", F.sha2("image_bytes", 256))
    rows = [("j2", "s", "approved", "2024-01-02"), ("j1", "s", "pending", "2024-01-02"), ("j3", None, "approved", "2024-01-01"), ("j4", "s", "rejected", "2024-01-01")]
    feedback = spark.createDataFrame(rows, "job_id string, correct_slug string, review_status string, d string").select(
        "*", F.lit("p").alias("predicted_slug"), F.to_timestamp("d").alias("created_at")).join(samples.select("image_sha256"))
    out = str(tmp_path / "out")
    reports.export_feedback_jsonl(feedback, samples, out)
    lines = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert [x["job_id"] for x in lines] == ["j1", "j2"] and lines[0]["image_path"].endswith(".png")
    with pytest.raises(AnalysisException):
        reports.export_feedback_jsonl(feedback, samples, out)
    assert reports.exportable_feedback(feedback, samples, approved_only=True).count() == 1
    wrong = samples.withColumn("image_bytes", F.lit(b"x"))
    with pytest.raises(Exception, match="hash mismatch"):
        reports.exportable_feedback(feedback, wrong).collect()
    images = spark.createDataFrame([("i", "e", 1.5, ["w"], "text")], "image_id string, engine string, processing_time_ms double, warnings array<string>, normalized_text string")
    blocks = spark.createDataFrame([("i", 1, "Hello", 0.5, "full")], "image_id string, pos long, text string, confidence double, variant string")
    fields = spark.createDataFrame([("i", "year", "2019", "2019", None, 1, None)], "image_id string, field_type string, value string, normalized_value string, confidence double, field_no long, variant string")
    lines = [r["line"] for r in reports.render_text_report(images, blocks, fields).orderBy("section", "item").collect()]
    assert lines[4:7] == ["Processing time, ms: 1.50", "Warnings: w", ""] and "- Hello [confidence: 0.500, full]" in lines
    assert lines[-14:-9] == ["(none)", "", "Candidate years", "---------------", "- 2019 (raw: 2019, confidence: n/a)"]
    reports.write_text_reports(reports.render_text_report(images, blocks, fields), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == len(lines)


def test_an_update_of_an_old_version_is_refused(spark, tmp_path):
    root = str(tmp_path)
    base = tables.write_table(spark.range(3), root, "u")
    assert tables.write_table(spark.range(4), root, "u", base=base) == 2
    with pytest.raises(RuntimeError):
        tables.write_table(spark.range(5), root, "u", base=base)
    assert tables.read_table(spark, root, "u").count() == 4
    assert tables.write_table(spark.range(6), root, "u") > 2 and tables.read_table(spark, root, "u").count() == 6
