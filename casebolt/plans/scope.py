"""Scopes and sessions: what is selected, how it is sorted, paged and shown. Plans are lazy; only ``render`` brings a page to the driver."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.functions import bates
from casebolt.operators import collection, families, search
from casebolt.plans.fields import ALIASES, PEOPLE, VIRTUAL, Catalog
from casebolt.plans.filters import compile_filter

# Limits and defaults of scopes and displays.
MAX_SAVED, MAX_DATASETS = 256, 999
COLUMNS = {
    "documents": ["content_type", "title", "author", "date_created", "control_number"],
    "conversations": ["conversation_id", "documents", "first_activity", "last_activity", "participants"],
    "entities": ["entity_id", "label", "entity_type", "documents"],
}


@dataclass(frozen=True)
class Scope:
    """Five slots, all of which must hold: keyword, Bates range, filter, datasets, a run's snapshot."""

    keyword: str | None = None
    bates: tuple[str, str] | None = None
    filter: str | None = None
    datasets: tuple[str, ...] = ()
    from_run: int | None = None

    def search(self, text: str, within: bool = False, full_text: bool = False) -> Scope:
        got = None if full_text else bates.parse_query(text)
        if got:
            span = bates.within(self.bates, got) if within else got
            return replace(self, bates=span or (got[1], got[0]), keyword=self.keyword if within else None)
        return replace(self, keyword=search.within(self.keyword, text) if within else text, bates=self.bates if within else None)

    def where(self, expression: str) -> Scope:
        return replace(self, filter=f"({self.filter}) AND ({expression})" if self.filter else expression)

    def within_datasets(self, *names: str) -> Scope:
        if len(names) > MAX_DATASETS:
            raise ValueError(f"more than {MAX_DATASETS} datasets")
        return replace(self, datasets=tuple(dict.fromkeys(names)))

    def clear(self, slot: str | None = None) -> Scope:
        return Scope() if slot is None else replace(self, **{slot: () if slot == "datasets" else None})

    @classmethod
    def load(cls, data: dict) -> Scope:
        """A scope of stored data; unknown slots and values of the wrong shape are left out."""
        b = data.get("bates")
        return cls(
            keyword=data.get("keyword") or None, filter=data.get("filter") or None,
            bates=tuple(b) if isinstance(b, (list, tuple)) and len(b) == 2 and all(isinstance(x, str) for x in b) else None,
            datasets=tuple(dict.fromkeys(x for x in data.get("datasets") or () if isinstance(x, str)))[:MAX_DATASETS],
            from_run=data["from_run"] if isinstance(data.get("from_run"), int) else None,
        )


@dataclass
class Corpus:
    """The DataFrames a scope is resolved against."""

    docs: DataFrame
    membership: DataFrame
    meta_postings: DataFrame | None = None
    chunk_postings: DataFrame | None = None
    chunks: DataFrame | None = None  # chunk, document_id
    snapshots: DataFrame | None = None  # run_id, id, ordinal
    people: DataFrame | None = None  # document_id, role, raw_value, entity_id, label
    productions: DataFrame | None = None  # production_id, production_name; documents have production_id
    parents: DataFrame | None = None  # id, parent_id, child_kind, lifecycle_status; documents themselves if not given
    multi: tuple[str, ...] = ()


def virtual_used(expression: str, columns: list[str]) -> set[str]:
    """Virtual fields that an expression names, texts in quotes aside."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", " ", expression)
    names = {ALIASES.get(w.lower(), w.lower()) for w in re.findall(r"[A-Za-z_]\w*", bare)}
    return (names & set(VIRTUAL)) - ({c.lower() for c in columns} - {"dataset_name"})


def with_virtual(docs: DataFrame, corpus: Corpus, used: set[str]) -> tuple[DataFrame, dict, tuple[str, ...]]:
    """Documents with what the virtual fields ``used`` need, the field's Column, and which of them hold several values. Only the fields
    used are joined; people and datasets are gathered per document before the join."""
    columns, multi = {}, []
    if "dataset_name" in used:
        names = corpus.membership.groupBy(F.col("document_id").alias("id")).agg(F.collect_set("dataset_name").alias("_v_dataset_name"))
        docs = docs.join(names, "id", "left")
    asked = {n: PEOPLE[n] for n in sorted(used & set(PEOPLE))}
    if asked:
        if corpus.people is None:
            raise ValueError(f"no people to filter {', '.join(asked)} by")
        values = [F.collect_set(F.when(F.col("role") == role, F.col(of))).alias(f"_v_{n}") for n, (role, of) in asked.items()]
        roles = sorted({role for role, _ in asked.values()})
        docs = docs.join(corpus.people.where(F.col("role").isin(*roles)).groupBy(F.col("document_id").alias("id")).agg(*values), "id", "left")
    for n in ({"dataset_name"} & used) | set(asked):
        columns[n] = F.col(f"_v_{n}")
        multi.append(n)
    if "production_name" in used:
        if corpus.productions is None or "production_id" not in docs.columns:
            raise ValueError("no productions to filter by")
        docs = docs.join(corpus.productions.select("production_id", F.col("production_name").alias("_v_production_name")), "production_id", "left")
        columns["production_name"] = F.col("_v_production_name")
    family = corpus.docs if corpus.parents is None else corpus.parents
    if "is_attachment" in used:
        mine = family.where(families.is_attachment()).select("id", F.lit(True).alias("_v_is_attachment"))
        docs = docs.join(mine, "id", "left")
        columns["is_attachment"] = F.coalesce("_v_is_attachment", F.lit(False))
    if "has_attachments" in used:
        docs = docs.join(families.has_attachments(family).select("id", F.lit(True).alias("_v_has_attachments")), "id", "left")
        columns["has_attachments"] = F.coalesce("_v_has_attachments", F.lit(False))
    return docs, columns, tuple(multi)


def resolve(scope: Scope, corpus: Corpus) -> DataFrame:
    """The selected documents; with a keyword their score (relevance), from a run their ordinal."""
    docs = collection.visible(corpus.docs, corpus.membership)
    if scope.datasets:
        docs = collection.in_datasets(docs, corpus.membership, list(scope.datasets))
    if scope.filter:
        base, columns, multi = with_virtual(docs, corpus, virtual_used(scope.filter, docs.columns))
        docs = base.where(compile_filter(scope.filter, Catalog(docs), columns, (*multi, *corpus.multi))).select(docs.columns)
    if scope.bates:
        a, b = (F.lit(x) for x in scope.bates)
        docs = docs.where(bates.overlaps("begin_bates", F.col("end_bates"), a, b))
    if scope.from_run is not None:
        docs = docs.join(corpus.snapshots.where(F.col("run_id") == scope.from_run).select("id", "ordinal"), "id")
    if scope.keyword:
        if corpus.chunk_postings is not None:
            hits = search.search_documents(corpus.meta_postings, corpus.chunk_postings, corpus.chunks, scope.keyword)
        else:
            hits = search.rank(corpus.meta_postings, scope.keyword)
        docs = docs.join(hits.select(F.col("doc").alias("id"), F.col("score").alias("relevance")), "id")
    return docs


def default_order(scope: Scope):
    if scope.keyword:
        return [F.col("relevance").asc(), F.col("id")]
    if scope.bates:
        return bates.order("begin_bates")
    if scope.from_run is not None:
        return [F.col("ordinal"), F.col("id")]
    return [F.col("date_created").desc_nulls_last(), F.col("id")]


@dataclass
class Session:
    """State of a user's browsing; a new scope goes back to page one, sort and columns stay."""

    scope: Scope = field(default_factory=Scope)
    mode: str = "documents"
    sort: list[tuple[str, str]] = field(default_factory=list)
    page: int = 1
    page_size: int = collection.PAGE
    columns: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in COLUMNS.items()})
    saved: dict[str, Scope] = field(default_factory=dict)

    def set_scope(self, scope: Scope) -> None:
        self.scope, self.page = scope, 1

    def save(self, name: str) -> None:
        key = " ".join(name.split())
        if not key or (key not in self.saved and len(self.saved) >= MAX_SAVED):
            raise ValueError("no name, or too many saved scopes")
        self.saved[key] = self.scope

    def recall(self, name: str) -> None:
        self.set_scope(self.saved[" ".join(name.split())])

    def set_sort(self, text: str, catalog: Catalog) -> None:
        keys = []
        for part in text.split(","):
            name, *direction = part.split()
            f = catalog.resolve(name)
            if not f.sortable or (direction and direction[0].lower() not in ("asc", "desc")):
                raise ValueError(f"cannot sort by {part.strip()}")
            keys.append((f.name, direction[0].lower() if direction else "asc"))
        self.sort = keys

    def set_columns(self, action: str, names: list[str], catalog: Catalog) -> list[str]:
        now = self.columns[self.mode]
        names = [catalog.resolve(n).name for n in names]
        bad = [n for n in names if not catalog.resolve(n).displayable]
        if bad:
            raise ValueError(f"cannot show {bad[0]}")
        now = {"set": names, "add": now + [n for n in names if n not in now], "remove": [n for n in now if n not in names], "default": list(COLUMNS[self.mode])}[action]
        self.columns[self.mode] = now
        return now

    def command(self, line: str, catalog: Catalog) -> None:
        """The session commands: /search, /bates, /filter, /dataset, /from-run, /sort, /page, /page-size, /next, /previous, /first,
        /columns, /scope save|load|clear, /documents, /conversations, /entities."""
        verb, _, rest = line.strip().lstrip("/").partition(" ")
        rest = rest.strip()
        if verb == "search":
            within, full = "--within" in rest, "--fts" in rest
            self.set_scope(self.scope.search(re.sub(r"\s*--(?:within|fts)\b", "", rest).strip(), within, full))
        elif verb == "bates":
            self.set_scope(replace(self.scope, bates=bates.parse_query(rest)))
        elif verb == "filter":
            self.set_scope(self.scope.clear("filter") if rest == "clear" else self.scope.where(rest))
        elif verb == "dataset":
            self.set_scope(self.scope.clear("datasets") if rest == "clear" else self.scope.within_datasets(*[x.strip() for x in rest.split(",")]))
        elif verb == "from-run":
            self.set_scope(replace(self.scope, from_run=None if rest == "clear" else int(rest)))
        elif verb == "scope":
            word, _, name = rest.partition(" ")
            {"save": lambda: self.save(name), "load": lambda: self.recall(name), "clear": lambda: self.set_scope(Scope())}[word]()
        elif verb == "sort":
            self.sort = [] if rest == "default" else self.sort
            if rest != "default":
                self.set_sort(rest, catalog)
        elif verb == "page":
            self.page = max(1, int(rest))
        elif verb == "page-size":
            self.page_size, self.page = max(1, min(int(rest), collection.PAGE_MOST)), 1
        elif verb in ("next", "previous", "first"):
            self.page = {"next": self.page + 1, "previous": max(1, self.page - 1), "first": 1}[verb]
        elif verb == "columns":
            word, _, names = rest.partition(" ")
            self.set_columns(word, [x.strip() for x in names.split(",") if x.strip()], catalog)
        elif verb in ("documents", "conversations", "entities"):
            self.mode, self.page = verb, 1
        else:
            raise ValueError(f"unknown command: {verb}")

    def current(self, corpus: Corpus) -> DataFrame:
        df = resolve(self.scope, corpus)
        return collection.page(df, collection.order(self.sort) if self.sort else default_order(self.scope), self.page, self.page_size)

    def write(self, path: str) -> None:
        """Session as JSON, through a temporary file beside it and a rename."""
        data = asdict(self) | {"scope": asdict(self.scope), "saved": {k: asdict(v) for k, v in self.saved.items()}}
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
        with os.fdopen(fd, "w") as f:
            json.dump(data, f)
        os.replace(tmp, path)

    @classmethod
    def read(cls, path: str) -> Session:
        """A stored session; a missing or damaged file is a new session."""
        try:
            with open(path) as f:
                data = json.load(f)
            return cls(
                Scope.load(data.get("scope") or {}), data.get("mode") if data.get("mode") in COLUMNS else "documents", [tuple(x) for x in data.get("sort") or []],
                max(1, int(data.get("page") or 1)), max(1, min(int(data.get("page_size") or collection.PAGE), collection.PAGE_MOST)),
                {k: list((data.get("columns") or {}).get(k) or v) for k, v in COLUMNS.items()}, {k: Scope.load(v) for k, v in (data.get("saved") or {}).items()},
            )
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()


def render(session: Session, corpus: Corpus) -> str:
    """The page as text: scope, sort, a table, and which documents of how many it shows."""
    df = resolve(session.scope, corpus)
    total = df.count()
    cols = [c for c in session.columns[session.mode] if c in df.columns]
    rows = collection.page(df, collection.order(session.sort) if session.sort else default_order(session.scope), session.page, session.page_size).select(*cols).collect()  # one page
    cell = lambda v: "" if v is None else ("Yes" if v else "No") if isinstance(v, bool) else str(v).replace("|", "\\|").replace("\n", " ")
    s = session.scope
    parts = [f"{k}: {v}" for k, v in (("keyword", s.keyword), ("Bates", "–".join(s.bates) if s.bates else None), ("filter", s.filter), ("datasets", ", ".join(s.datasets)), ("run", s.from_run)) if v]
    first = (session.page - 1) * session.page_size + 1
    lines = ["Scope: " + ("; ".join(parts) or "all documents"), "Sort: " + (", ".join(" ".join(x) for x in session.sort) or "default"), "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows]
    return "\n".join([*lines, "", f"Documents {first}-{first + len(rows) - 1} of {total}" if rows else f"No documents on this page, {total} in all"])
