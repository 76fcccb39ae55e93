"""The evidence stage: order of sources, citations, readings, stored results, stages that go on."""

import pytest
from pyspark.sql import functions as F

from flagstone.operators.retrieve import Search
from flagstone.operators.state import Checklist, Item
from flagstone.plans import evidence as EV
from flagstone.plans.evidence import Route
from flagstone.plans.stages import Stages

PASSAGES = "run_id long, item_id string, rn int, doc_id long, url string, page int, passage string"
HITS = "company_id long, item_id string, rn int, url string, passage string"
READINGS = (
    "run_id long, item_id string, seq int, page int, value string, evidence string, rationale string, confidence string, "
    "provider string, error string"
)
LIST = Checklist(tuple(Item(i, i.split("-")[0]) for i in ("D-1", "W-1", "B-1", "N-1")))


def routes():
    doc = lambda i: Search(i, ("ANNUAL_REPORT",), ("word",))
    return [
        Route(doc("D-1")), Route(doc("W-1"), web=True, web_first=True), Route(doc("B-1"), web=True), Route(Search("N-1", ())),
    ]


@pytest.fixture
def pieces(spark):
    runs = spark.createDataFrame([(1, 10, "T"), (2, 20, None), (3, 30, "")], "run_id long, company_id long, ticker string")
    passages = spark.createDataFrame(
        [(r, i, n, 100 * r + n, f"d{r}{n}", n + 4, "p") for r in (1, 2) for i in ("D-1", "W-1") for n in (2, 1)], PASSAGES
    )
    hits = spark.createDataFrame(
        [(c, i, 1, f"w{c}", "h") for c in (10, 20) for i in ("W-1", "B-1", "D-1")] + [(10, None, 1, "w", "h")], HITS
    )
    return runs, passages, hits


def test_order_of_sources(pieces):
    runs, passages, hits = pieces
    rows = EV.evidence_rows(EV.choose_places(runs, routes(), passages, hits)).collect()
    got = {(r.run_id, r.item_id): (r.source, r.places, r.doc_id, r.url, r.page, r.note) for r in rows}
    assert got == {
        (1, "D-1"): ("document", 2, 101, "d11", 5, None), (1, "W-1"): ("web", 1, None, "w10", None, None),
        (1, "B-1"): ("web", 1, None, "w10", None, None), (1, "N-1"): (None, 0, None, None, None, "nothing to look in"),
        # an unlisted company's own documents come before the web
        (2, "D-1"): ("document", 2, 201, "d21", 5, None), (2, "W-1"): ("document", 2, 201, "d21", 5, None),
        (2, "B-1"): ("web", 1, None, "w20", None, None), (2, "N-1"): (None, 0, None, None, None, "nothing to look in"),
        (3, "D-1"): (None, 0, None, None, None, "no passage"), (3, "W-1"): (None, 0, None, None, None, "no passage and no hit"),
        (3, "B-1"): (None, 0, None, None, None, "no passage and no hit"), (3, "N-1"): (None, 0, None, None, None, "nothing to look in"),
    }


def test_readings(spark, pieces):
    chosen = EV.choose_places(pieces[0], routes(), *pieces[1:])
    readings = spark.createDataFrame(
        [
            (1, "D-1", 1, 5, "old", None, None, "low", "a", None), (1, "D-1", 2, 6, "new", "q", "why", "high", "a", None),
            (1, "W-1", 1, 9, "seen", None, None, "high", "a", None), (1, "B-1", 1, None, None, None, None, None, "a", "timed out"),
            (2, "D-1", 1, 77, "Not available", None, None, "high", "a", None), (3, "D-1", 1, 1, "made up", None, None, "high", "a", None),
            (2, "X-9", 1, 1, "unknown item", None, None, "high", "a", None),
        ],
        READINGS,
    )
    rows = EV.with_readings(chosen, readings, LIST).select("run_id", F.explode("_by_item").alias("i", "f")).select("run_id", "i", "f.*").collect()
    got = {(r.run_id, r.i): (r.value, r.source, r.deferred, r.doc_id, r.page, r.url, r.confidence, r.error) for r in rows}
    assert got[1, "D-1"] == ("new", "document", False, 102, 6, "d12", "high", None)  # the last reading, its own page
    assert got[1, "W-1"] == ("seen", "web", False, None, None, "w10", "low", None)  # the web is never sure
    assert got[1, "B-1"] == (None, "web", False, None, None, None, "low", "timed out")
    assert got[2, "D-1"] == (None, "document", False, 201, 5, "d21", "low", None)  # no such page: the first place
    assert got[2, "W-1"] == (None, "document", True, 201, 5, "d21", None, None)
    assert got[3, "D-1"] == (None, "none", False, None, None, None, "low", None)  # nothing to read, the reading counts for nothing
    assert len(got) == 12


def test_to_read_asks_nothing_twice(spark, pieces):
    runs, passages, hits = pieces
    chosen = EV.choose_places(runs, routes(), passages, hits)
    none = spark.createDataFrame([], READINGS)
    asked = lambda readings: {(r.run_id, r.item_id, r.source, r.rn) for r in EV.to_read(chosen, passages, hits, readings).collect()}
    first = asked(none)
    assert (1, "D-1", "document", 2) in first and (1, "W-1", "web", 1) in first and (2, "W-1", "document", 1) in first
    assert (1, "W-1", "document", 1) not in first and len(first) == 2 + 1 + 1 + 2 + 2 + 1
    some = spark.createDataFrame(
        [(1, "D-1", 1, 5, "x", None, None, "low", "a", None), (2, "D-1", 1, 5, None, None, None, None, "a", "timed out")], READINGS
    )
    # an answer is final, an error is asked for again
    assert first - asked(some) == {(1, "D-1", "document", 1), (1, "D-1", "document", 2)}


def test_empty_tables(spark, pieces):
    empty = lambda schema: spark.createDataFrame([], schema)
    chosen = EV.choose_places(pieces[0], routes(), empty(PASSAGES), empty(HITS))
    assert {r.source for r in EV.evidence_rows(chosen).collect()} == {None}
    assert EV.with_readings(chosen, empty(READINGS), LIST).count() == 3


def test_store_keeps_what_a_wait_did_not_change(spark):
    shape = "run_id long, item_id string, status string, error string, " + ", ".join(
        f"{c} {dict(confidence='double', gate_pass='boolean', doc_id='long', page='int').get(c, 'string')}" for c in EV.STORED
    )
    row = lambda item, status, flag, error=None: (1, item, status, error, flag, "v", *[None] * (len(EV.STORED) - 2))
    stored = spark.createDataFrame([row("a", "DONE", "GREEN"), row("b", "DEFERRED", "RED"), row("c", "ERROR", None, "x")], shape)
    results = spark.createDataFrame([row("b", "DEFERRED", None, "wait"), row("c", "DONE", "GREEN"), row("d", "DEFERRED", None, "wait")], shape)
    out = EV.store_results(stored.withColumn("attempts", F.lit(3)), results).collect()
    assert {(r.item_id, r.status, r.flag, r.error, r.attempts) for r in out} == {
        ("a", "DONE", "GREEN", None, 3), ("b", "DEFERRED", "RED", "wait", 4), ("c", "DONE", "GREEN", None, 4), ("d", "DEFERRED", None, "wait", 1),
    }


def test_stages_go_on_behind_the_last_whole_one(spark, tmp_path):
    stages, built = Stages(spark, str(tmp_path)), []

    def build(n, fail=False):
        def run():
            built.append(n)
            return spark.range(n).withColumn("x", F.raise_error(F.lit("lost")).cast("int") if fail else F.lit(1))

        return run

    assert stages.table("one", build(3)).count() == 3
    with pytest.raises(Exception, match="lost"):
        stages.table("two", build(4, fail=True))
    assert not stages.whole("two")
    again = Stages(spark, str(tmp_path))
    assert again.table("one", build(5)).count() == 3 and again.table("two", build(4)).count() == 4
    assert built == [3, 4, 4]


def test_gather_reads_the_texts_once(spark, pieces, tmp_path):
    runs = pieces[0]
    documents = spark.createDataFrame(
        [(1, 7, 1, "ANNUAL_REPORT", False, "u7", "a word and a word"), (1, 8, 2, "WEB", False, "u8", "word"), (3, 9, 1, "WEB", True, "u9", "no")],
        "run_id long, doc_id long, doc_order long, doc_type string, unlisted boolean, url string, text string",
    )
    hits = spark.createDataFrame(
        [(10, "W-1", 0, 0, "https://news.example.org/1", "Acme found", "", "Acme Limited", "ACME")],
        "company_id long, item_id string, query_idx int, pos int, url string, title string, snippet string, name string, ticker string",
    )
    stages = Stages(spark, str(tmp_path))
    passages, kept, places = EV.gather(runs, LIST, documents, hits, stages, routes())
    got = {(r.run_id, r.item_id): (r.source, r.doc_id, r.url) for r in EV.evidence_rows(places).collect() if r.source}
    assert got == {(1, "D-1"): ("document", 7, "u7"), (1, "W-1"): ("web", None, "https://news.example.org/1"), (1, "B-1"): ("document", 7, "u7")}
    # a second pass over the same folder builds nothing: the documents are gone and it still answers
    gone = documents.filter("false")
    assert EV.evidence_rows(EV.gather(runs, LIST, gone, hits, stages, routes())[2]).count() == 12


def test_routes_of_a_checklist(spark):
    listed = Checklist((Item("A14-01", "A14"), Item("A9-04", "A9"), Item("A2-01", "A2"), Item("Z-1", "Z", "Number of plants", output_format="Ratio")))
    got = {r.search.item_id: r for r in EV.routes_of(spark, listed)}
    assert not got["A14-01"].reads_documents and not got["A14-01"].web
    assert got["A9-04"].web and got["A9-04"].web_first and got["A2-01"].search.note_mode and not got["A2-01"].web
    assert not got["Z-1"].reads_documents
