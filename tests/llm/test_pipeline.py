"""The pipeline's stages that choose among documents against brute force, and the whole of it on rows without ids and with repeated ones."""

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_document_operators import _components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    near = prose(1, 120).split(" ")
    near[60] = "changed"
    texts = [
        (5, prose(1, 120)), (7, " ".join(near)), (None, prose(1, 120)), (None, prose(2, 90)), (None, prose(2, 90)), (None, prose(3, 80)),
        (9, prose(4, 70)), (9, prose(5, 75)), (9, prose(5, 75)), (3, prose(6, 60)), (3, prose(1, 120)), (11, prose(6, 60)), (12, "short"),
        (None, prose(7, 20) + " " + prose(8, 70) + " " + prose(9, 60)), (20, prose(10, 60) + " " + prose(8, 70) + " " + prose(11, 70)), (20, prose(12, 65)),
    ]
    return [(i, t, "en", "s", len(t)) for i, t in texts]


def _once(rows):
    """Different (doc_id, text), those without ids last."""
    return sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_near_duplicates_keep_rows_not_ids(spark):
    rows = _once(_rows())
    groups = {}
    for number, _, first in _components([(k, t) for k, (_, t) in enumerate(rows)]):
        groups.setdefault(first, []).append(rows[number])
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(_rows(), SCHEMA), "").collect()]
    assert len(out) == len(groups)
    for own in groups.values():
        kept = [x for x in out if x in own]
        assert len(kept) == 1 and kept[0][0] == own[0][0]


def test_repeated_passages_by_row(spark):
    docs = corpus_pipeline.repeated_passages(spark, spark.createDataFrame([r for r in _rows() if r[0] in (None, 20)], SCHEMA), "")
    out = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    cut = f"{prose(7, 20)}  {prose(9, 60)}"
    expected = [(20, prose(10, 60) + " " + prose(8, 70) + " " + prose(11, 70)), (20, prose(12, 65)), (None, prose(1, 120)), (None, prose(2, 90)), (None, prose(3, 80)), (None, cut)]
    assert out == sorted(expected, key=str)


def test_language_and_secrets_keep_every_row(spark):
    rows = [(None, "token=abcdefgh12 and more words here", "en", "s", 36), (4, "plain words stand here", "en", "s", 22), (4, "other plain words", "en", "s", 17)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert corpus_pipeline.language(spark, docs, "").count() == 3
    out = {r["text"]: (r["doc_id"], r["n_chars"]) for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert out == {"[REDACTED] and more words here": (None, 30), "plain words stand here": (4, 22), "other plain words": (4, 17)}


def test_run(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    near = len({first for *_, first in _components([(k, t) for k, (_, t) in enumerate(_once(_rows()))])})
    assert len(out) == near  # a piece a document
    assert sum(r["doc_id"] is None for r in out) == 3 and sum(r["doc_id"] == 9 for r in out) == 2


CLASHING = ["h1", "h2", "number", "own_id", "spans", "n", "component_id", "text_hash", "id", "hash", "piece"]


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_keep_columns_whose_names_are_their_own(spark, repeated):
    """Every stage but the last gives back the columns of its documents, with their values, whatever they are called; ids as they are and repeated ones."""
    rows = [(i if repeated or i is not None else 100 + k, t, "en", "s", len(t)) for k, (i, t, *_) in enumerate(_rows()) if repeated or (i, t) not in [(x[0], x[1]) for x in _rows()[:k]]]
    if not repeated:
        rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    docs = spark.createDataFrame([(*r, *(f"{c}{r[1][:9]}" for c in CLASHING)) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r["text"] and all(r[c].startswith(c) and len(r[c]) > len(c) for c in CLASHING), name
        assert stage(spark, docs.where("false"), "").collect() == [], name


def test_secrets_of_a_long_text(spark):
    text = "plain words " * 20000 + "token=abcdefgh12345 end"
    out = corpus_pipeline.secrets(spark, spark.createDataFrame([(1, text, "en", "s", 1)], SCHEMA), "").first()
    assert out["text"] == "plain words " * 20000 + "[REDACTED] end" and out["n_chars"] == len(out["text"])
