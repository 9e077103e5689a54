"""From raw books to what a reader is served, in one plan.

Books are parsed once: the raw blocks, and what overrides and illustrations make of them,
are written to the shared folder, and every output starts from there.  Overrides and
illustrations are small tables that Catalyst broadcasts when their size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from inkstone.operators import enrich, paginate, parse, spans
from inkstone.sources.stage import settle


@dataclass
class Books:
    """The tables of a parsed corpus."""

    blocks_raw: DataFrame
    blocks: DataFrame
    toc: DataFrame
    paged: DataFrame
    pages: DataFrame
    volumes: DataFrame


def compile_books(books: DataFrame, overrides: DataFrame | None = None, illustrations: DataFrame | None = None) -> Books:
    """The tables for books (book_id, title, source).

    The contents come from the corrected blocks, before illustrations; blocks_raw has no
    corrections, as the report and the review queue need it.
    """
    raw = settle(parse.parse(books))
    tasks = None if overrides is illustrations is None else spans.measured(raw)[1]
    fixed = raw if overrides is None else enrich.apply_overrides(raw, overrides, tasks)
    shown = fixed if illustrations is None else enrich.inject_illustrations(fixed, illustrations, tasks)
    heads = parse.table_of_contents(fixed)
    if shown is not raw:
        shown = settle(shown)
    # Positions move when illustrations are injected; ids do not.
    toc = heads if illustrations is None else heads.drop("block_seq").join(shown.select("book_id", "block_id", "block_seq"), ["book_id", "block_id"]).select(*heads.columns)
    # Pages are cut once, for the blocks and for the table of pages.
    volumes = settle(paginate.assign_pages(paginate.with_volume(shown)))
    paged = volumes.select(*shown.columns, "page_index")
    return Books(raw, shown, toc, paged, paginate.pages(books, volumes), volumes.drop("page_index"))
