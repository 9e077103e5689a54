"""The steps behind the parser: the more text, the more tasks, so what one task holds stays the same."""

import re

import pytest

from inkstone import queries as Q
from inkstone.operators import paginate, parse, spans

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plans(spark, monkeypatch):
    """Small shares, no broadcasts, and the plans of what is written on the way."""
    found = []
    for module in (Q, paginate):
        monkeypatch.setattr(module, "settle", lambda df, settle=module.settle: found.append(plan(df)) or settle(df))
    monkeypatch.setattr(spans, "SHARE", 20_000, raising=False)
    monkeypatch.setattr(parse, "SHARE", 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield found
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df, mode="simple"):
    """The plan as it is chosen before any stage has run."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def below(text, node):
    """To how many tasks the rows of each such node are dealt."""
    return [int(re.search(r"Exchange hashpartitioning\(.*, (\d+)\)", text[m.start() :])[1]) for m in re.finditer(rf"\b{node}\b", text)]


@pytest.mark.parametrize("query,nodes", [("overrides_applied", ["SortMergeJoin"]), ("illustration_injection", ["SortMergeJoin", "Window"]), ("review_queue", ["SortMergeJoin", "Window"])])
def test_what_is_laid_over_blocks_is_dealt_by_text(spark, plans, query, nodes):
    text = plan(Q.queries()[query](spark, SF))
    want = spans.measured(parse.parse(Q.books(spark, SF).unionByName(Q.fixture_books(spark))))[1]
    assert want > 8
    for node in nodes:
        assert (got := below(text, node)) and set(got) == {want}, node


@pytest.mark.parametrize("query", ["page_of_block", "paginate_books", "toc_answers"])
def test_pages_are_cut_by_tasks_in_proportion(spark, plans, query):
    last = plan(Q.queries()[query](spark, SF))
    want = spans.measured(parse.parse(Q.books(spark, SF).unionByName(Q.fixture_books(spark))))[1]
    # The first plan is the parser's.
    for text in [*plans[1:], last]:
        assert set(below(text, "Window")) <= {want}
    assert any(below(text, "Window") for text in plans[1:]) and below(last, "Window")


def test_active_items_are_found_by_tasks_in_proportion(spark, plans):
    last = plan(Q.active_toc(spark, SF))
    want = spans.measured(parse.parse(Q.books(spark, SF).unionByName(Q.fixture_books(spark))))[1]
    assert set(below(last, "Window")) == {want}


@pytest.mark.parametrize("query", ["page_fetch", "page_fetch_at"])
def test_books_that_are_asked_for_are_dealt_by_text(spark, plans, query):
    Q.queries()[query](spark, SF)
    want = parse.measured(Q.books(spark, SF))[1]
    assert want > 8 and below(plans[0], "SortMergeJoin") == [want]
    # Volumes are found where books were parsed: blocks are written once, then pages.
    assert len([p for p in plans if "rlike" in p.lower()]) == 1


@pytest.mark.parametrize("query", ["overrides_applied", "paginate_books"])
def test_contents_that_nobody_asks_for_are_not_sent(spark, plans, query):
    """Keys and lengths are made before rows are exchanged."""
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan(Q.queries()[query](spark, SF), "formatted"))
    assert sent and not [x for x in sent if "content#" in x]
