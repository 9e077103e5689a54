"""A registry of named tools over DataFrame functions, with validated arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


class ToolError(ValueError):
    """An unknown tool, a missing permission or a bad argument."""


@dataclass
class Tool:
    name: str
    run: Callable
    required: tuple[str, ...] = ()
    permission: str | None = None


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def call(self, name: str, arguments: dict, permissions: frozenset[str] = frozenset()):
        tool = self.tools.get(name)
        if tool is None:
            raise ToolError(f"unknown tool: {name}")
        if tool.permission and tool.permission not in permissions:
            raise ToolError(f"{name} needs the permission {tool.permission}")
        if missing := [a for a in tool.required if not arguments.get(a)]:
            raise ToolError(f"{name} lacks {', '.join(missing)}")
        return tool.run(**arguments)


def standard(spark, docs, books) -> Registry:
    """The tools over a catalog with content and compiled books: search, entries, chapters, neighbours."""
    from inkstone.operators import catalog, retrieve, search
    from pyspark.sql import functions as F

    registry = Registry()
    found = (
        Tool("search_catalog", lambda query, page=1: search.dispatch(docs, query, "meta", page), ("query",)),
        Tool("search_text", lambda query, page=1: search.find(docs, query, page), ("query",)),
        Tool("get_entry", lambda entry_id: catalog.by_id(docs, entry_id), ("entry_id",)),
        Tool("get_chapter", lambda book_id: search.chapter(books.blocks_raw, books.toc, book_id), ("book_id",)),
        Tool("related_books", lambda entry_id: catalog.related(docs).where(F.col("id") == entry_id).orderBy("rank"), ("entry_id",)),
        Tool("find_references", lambda question, reading=None: retrieve.references(spark, docs, question, reading), ("question",)),
    )
    for tool in found:
        registry.add(tool)
    return registry
