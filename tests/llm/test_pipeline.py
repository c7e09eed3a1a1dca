"""The stages against plain loops, each on its predecessor's rows."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_copies import brute_pairs
from tests.llm.test_simhash import groups as linked_groups
from tests.llm.util import WORD, low

SF = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before = docs.collect()
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
    before, after = seen["exact_dedup"]
    assert {r.doc_id for r in after} == set({low(r.text): r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}.values())
    before, after = seen["near_dedup"]
    texts = {r.doc_id: r.text for r in before}
    groups = linked_groups(brute_pairs(texts), texts)
    assert {r.doc_id for r in after} == {i for i, c in groups.items() if i == c}
    before, after = seen["mixing"]
    taken = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert taken == {i: v[3] for i, v in brute_mix([(r.doc_id, r.text, r.source) for r in before]).items() if v[3]}
    before, after = seen["packing"]
    t = Tokenizer.from_file(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    ids = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == ids
    assert max(np.bincount(np.unique([r.sequence_id for r in after], return_inverse=True)[1], [r.length for r in after])) <= 1024


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_run_takes_repeated_and_null_ids(spark, tmp_path):
    """A row that stands 40 times is taken once or twice, rows without an id are taken, and no source gives above its target."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "a plain sentence that stands nowhere else in the table and says little about anything at all"
    odd = spark.createDataFrame([(10**6, text, "en", "odd", len(text))] * 40 + [(None, f"{text} {text[::-1]}", "en", "odd", 2 * len(text) + 1)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("source = 'odd'")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 1 <= docs.where("doc_id IS NOT NULL").count() <= 2 and 1 <= docs.where("doc_id IS NULL").count() <= 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def written(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_stages_write_no_texts_beside_their_rows(spark, tmp_path, monkeypatch):
    """Rows are told apart by their ids, so no stage keeps a second copy of all texts, and shuffle files go with the step that made them."""
    rnd = np.random.default_rng(1)
    texts = [" ".join(map(str, rnd.integers(0, 10**9, 1_000))) for _ in range(40)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts + texts[:4])],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    size = written(tmp_path / "docs")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        monkeypatch.setattr("tidemark.session.shared_folder", lambda _, name=name: f"{tmp_path}/{name}")
        assert stage(spark, docs, str(tmp_path)).count() >= 40
        print(f"{name}: {written(tmp_path / name)} of {size} bytes")
        assert written(tmp_path / name) < size / 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_toxicity_and_near_copies_drop_what_other_stages_keep_in_a_worker(spark):
    """The ids and automata that a worker keeps for one stage don't stay beside the next."""
    from tidemark.llm import near_copies, toxicity
    from tidemark.llm.common import worker_store

    docs = spark.createDataFrame([(1, "some plain words that say nothing", 0), (2, "other words", 1)], "__row long, text string, toxic int").coalesce(1)

    def kept(frame, name):
        """Whether the store ``name``, filled before the frame's rows in the same process, is still there after them."""
        seen = {}

        class Rows:
            dtypes = docs.dtypes

            def mapInArrow(self, run, schema):
                import pyarrow as pa

                seen["out"] = list(run([pa.RecordBatch.from_pylist(frame)]))
                return docs.selectExpr("text AS word", "toxic AS yes", "toxic AS no")

        worker_store(name)["x"] = 1
        near_copies._sets(Rows(), 5, False) if "__row" in frame[0] else toxicity._lexicon(Rows(), 1, 1)
        return bool(worker_store(name)) and bool(seen["out"])

    assert not kept([{"__row": 1, "text": "some plain words"}], "automata")
    assert not kept([{"toxic": 1, "text": "some plain words"}], "encoders")
