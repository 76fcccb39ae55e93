"""Passages worked out once for places and texts."""

from flagstone.catalog import evidence, load_all


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_to_read_reads_documents_once(tables, monkeypatch):
    built = []
    known = evidence.EV.document_evidence
    monkeypatch.setattr(evidence.EV, "document_evidence", lambda *a: built.append(1) or known(*a))
    df = load_all()["evidence_to_read"].run(tables)
    assert len(built) == 1
    assert "documents.parquet" not in plan(df)
