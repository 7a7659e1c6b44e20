"""The pipeline, stage by stage, on awkward documents; and the registered queries."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfmatch.llm import queries
from shelfmatch.llm.byte_pairs import Codec, public_ranks
from shelfmatch.llm.mixing import in_order, mixed
from shelfmatch.session import checkpoint_dir
from tests.llm.helpers import LONG, documents

NAMES = ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    prose = [" ".join(f"word{(i * 37 + k * k) % 1009}" for k in range(60)) + f"\nThis closing line belongs to document {i % 7} only." for i in range(30)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(40, prose[3]), (41, None), (42, ""), (None, prose[5]), (43, LONG), (44, "x & y " * 30)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != NAMES[-1]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{checkpoint_dir(spark)}/test-{name}-{id(folder)}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
    assert kept == [32, 32, 31, 31, 31]


def test_run_matches_its_texts(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    coder = Codec(*public_ranks())
    text = " ".join(f"word{k * k % 1009}" for k in range(60)) + "\nThis closing line belongs to document 0 only."
    first = next(r for r in rows if r.doc_id == 0)
    assert first.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and first.n_tokens == len(coder.encode(text)) // 4


def test_run_shows_the_mix(spark, tmp_path):
    letters = [" ".join(f"w{(i * 7919 + k * k * 31) % 4001}" for k in range(60)) for i in range(90)]
    documents(spark, list(enumerate(letters))).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [r.doc_id for r in sorted(mixed(docs, block_rows=4).select("doc_id", "mix_position").collect(), key=lambda r: r.mix_position)]
    in_order(docs, block_rows=4).repartitionByRange(5, "doc_id").write.parquet(f"{tmp_path}/other")
    in_order(docs, block_rows=4).write.option("maxRecordsPerFile", 7).parquet(f"{tmp_path}/mix")

    def order(path):
        rows = corpus_pipeline.encode(spark, spark.read.parquet(path), str(tmp_path)).collect()
        assert sorted(r.mix_place for r in rows) == list(range(90))
        return [r.doc_id for r in sorted(rows, key=lambda r: r.mix_place)]

    assert order(f"{tmp_path}/mix") == want != order(f"{tmp_path}/other")


def test_all_are_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
