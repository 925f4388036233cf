import subprocess
import sys

import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from framequorum.llm import common, pieces, repeats

from .conftest import prose
from .test_suffix_repeats import brute


def test_stages(spark, tmp_path):
    shared = prose(50, 60)
    rows = [(i, prose(i, 120) + (" " + shared if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(24)]
    rows += [(30, rows[1][1], "en", "s0", 1), (31, rows[2][1] + " tail", "en", "s1", 1), (32, "", "en", "s1", 0), (33, "12345 67890", "en", "s2", 1), (34, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path)).cache()
        at[name] = docs.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    first, near, cut, mixed, last = (at[n] for n, _ in corpus_pipeline.STAGES)
    assert {r.doc_id for r in first} == set(range(24)) | {30, 31}
    assert {r.doc_id for r in near} == set(range(24))
    lost = {k[0]: k[2] for k in brute([(r.doc_id, r.text) for r in near])}
    assert {r.doc_id: len(r.text.encode()) for r in cut} == {r.doc_id: len(r.text.encode()) - lost[r.doc_id] for r in near}
    assert all(r.n_chars == len(r.text) for r in cut) and sum(lost.values()) > 0
    texts = {r.doc_id: r.text for r in cut}
    assert mixed and all(r.text == texts[r.doc_id] for r in mixed)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    assert sorted((r.doc_id, list(r.ids)) for r in last) == sorted((r.doc_id, sp.encode(r.text)) for r in mixed) and all(r.round_trip for r in last)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []


def test_workers_hold_one_operator():
    """A worker that encoded texts keeps the vocabulary for the next task of that operator, but not for others; no stage needs pandas."""
    pieces.loaded(open(pieces.MODEL_PATH, "rb").read())
    repeats._powers(1000)
    assert list(common.lean(lambda b: iter([len(pieces._LOADED), len(repeats._POWERS)]), "pieces")([])) == [1, 0]
    repeats._powers(1000)
    assert list(common.lean(lambda b: iter([len(pieces._LOADED), len(repeats._POWERS)]), "repeats")([])) == [0, 2]
    assert list(common.lean(lambda b: iter([len(repeats._POWERS)]))([])) == [0]
    code = "import sys; from framequorum.llm import langid, mixing, pieces, repeats, simhash; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"
