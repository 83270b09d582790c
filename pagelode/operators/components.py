"""components that recur across pages, by hashes of element subtrees."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.core import spread
from ..session import ship_package
from .dom import _PAGES_PER_BATCH, _PY_WS, _Elements, _walk, child_signature

_TREE = "page_id long, pos int, signature string, hash string, family string, size int, parent_hash string"


_FORMS = "hash string, page_id long, n long, pos int, low string, high string, inside long, signature string, family string, size int"


def _hashed(parents: list[int | None], signatures: list[str], tags: list[str]) -> tuple[list[str], list[str], list[int]]:
    """Hashes, families and sizes of all subtrees of one page, children before parents; ``parents`` are places in the lists.

    The hash of an element is that of its signature and the set of its children's hashes: neither the order of children nor how
    often one recurs matters, so lists of any length with equal items are equal. ``size`` counts the elements of that form;
    ``family`` is the same hash over tags alone.
    """
    below: list[dict[str, int]] = [{} for _ in parents]
    families: list[set[str]] = [set() for _ in parents]
    hashes, sizes, kin = [""] * len(parents), [0] * len(parents), [""] * len(parents)
    for i in range(len(parents) - 1, -1, -1):
        hashes[i] = hashlib.md5(f"{signatures[i]}({','.join(sorted(below[i]))})".encode()).hexdigest()
        kin[i] = hashlib.md5(f"{tags[i]}({','.join(sorted(families[i]))})".encode()).hexdigest()
        sizes[i] = 1 + sum(below[i].values())
        if parents[i] is not None:
            below[parents[i]][hashes[i]] = sizes[i]
            families[parents[i]].add(kin[i])
    return hashes, kin, sizes


def _fold(page: pa.Table) -> pa.Table:
    """Hashes of all subtrees of one page (see ``_hashed``)."""
    page = page.sort_by([("pos", "ascending")])
    place = {pos: i for i, pos in enumerate(page["pos"].to_pylist())}
    parents = [place.get(p) for p in page["parent_pos"].to_pylist()]
    hashes, kin, sizes = _hashed(parents, page["signature"].to_pylist(), page["tag"].to_pylist())
    return pa.table({
        "page_id": page["page_id"], "pos": page["pos"], "signature": page["signature"], "hash": pa.array(hashes),
        "family": pa.array(kin), "size": pa.array(sizes, pa.int32()),
        "parent_hash": pa.array([None if p is None else hashes[p] for p in parents], pa.string())})


@lru_cache(maxsize=8192)
def _signature(tag: str, role: str, names: str) -> str:
    """``child_signature`` of an element."""
    return f"{tag}|{role}|{'.'.join(sorted(c for c in _PY_WS.split(names) if c))}"


def page_forms(pages: DataFrame, max_elements: int | None = R.MAX_ELEMENTS) -> DataFrame:
    """What ``forms_per_page`` finds, straight from ``page_id, html``: one row per subtree form and page.

    A page is walked, hashed and added up where it lies, so no element is a row and none is shuffled. Page ids are unique;
    pages with a null id are left out.
    """
    names = [f.split()[0] for f in _FORMS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in _FORMS.split(", ")]

    def of_page(page_id, html: str):
        out, rows = _Elements(), {}
        _walk(html, max_elements, False, out)
        ends, signatures = out.attrs_end, []
        for i, tag in enumerate(out.tag):
            attrs = dict(zip(out.names[ends[i]:ends[i + 1]], out.values[ends[i]:ends[i + 1]]))
            signatures.append(_signature(tag, attrs.get("role", ""), attrs.get("class", "")))
        parents = [p if p >= 0 else None for p in out.parent]
        hashes, kin, sizes = _hashed(parents, signatures, out.tag)
        for i, (form, above) in enumerate(zip(hashes, parents)):
            up = None if above is None else hashes[above]
            row = rows.get(form)
            if row is None:
                rows[form] = [form, page_id, 1, i, up, up, int(up is not None), signatures[i], kin[i], sizes[i]]
            else:
                row[2] += 1
                if up is not None:
                    row[4], row[5], row[6] = min(row[4] or up, up), max(row[5] or up, up), row[6] + 1
        return rows.values()

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _PAGES_PER_BATCH):
                some = batch.slice(first, _PAGES_PER_BATCH)
                rows = [r for k, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist()) for r in of_page(k, html or "")]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ship_package(pages.sparkSession)
    return spread(pages.filter("page_id is not null").select("page_id", "html"), "page_id").mapInArrow(run, _FORMS)


def subtree_hashes(nodes: DataFrame) -> DataFrame:
    """Bottom-up hashes of the element table: ``page_id, pos, signature, hash, family, size, parent_hash``.

    A page is one group: its elements are as many as its one row of markup holds. Pages with a null id are left out.
    """
    ship_package(nodes.sparkSession)
    slim = nodes.filter("page_id is not null").select("page_id", "pos", "parent_pos", "tag", child_signature().alias("signature"))
    return slim.groupBy("page_id").applyInArrow(_fold, _TREE)


def forms_per_page(nodes: DataFrame) -> DataFrame:
    """One row per subtree form and page of an element table; ``low``, ``high`` and ``inside`` tell of the forms around it."""
    return subtree_hashes(nodes).groupBy("hash", "page_id").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos"), F.min("parent_hash").alias("low"), F.max("parent_hash").alias("high"),
        F.count("parent_hash").alias("inside"), F.min("signature").alias("signature"), F.min("family").alias("family"),
        F.min("size").alias("size"))


def component_inventory(nodes: DataFrame, least_size: int = 3, least_pages: int = 2) -> DataFrame:
    """``inventory`` of an element table."""
    return inventory(forms_per_page(nodes), least_size, least_pages)


def inventory(per_page: DataFrame, least_size: int = 3, least_pages: int = 2) -> DataFrame:
    """One row per component: ``component, family, variants, signature, size, pages, instances, page_id, pos``.

    A component is a subtree form of at least ``least_size`` elements on at least ``least_pages`` pages. Forms that only ever
    occur inside one larger form are part of it and have no row. ``page_id, pos`` is the first instance; ``variants`` counts
    the components of the same family, that is, equal but for roles and classes.

    ``per_page`` has a row per form and page (``page_forms``, ``forms_per_page``); these are added up with partial sums before
    the shuffle: a component on a third of all pages sends one row per task.
    """
    forms = per_page.filter(F.col("size") >= least_size).groupBy("hash").agg(
        F.count("*").alias("pages"), F.sum("n").alias("instances"), F.min(F.struct("page_id", "pos")).alias("first"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("inside").alias("inside"),
        F.min("signature").alias("signature"), F.min("family").alias("family"), F.min("size").alias("size"))
    part_of_one = (F.col("inside") == F.col("instances")) & (F.col("low") == F.col("high"))
    kept = forms.filter((F.col("pages") >= least_pages) & ~part_of_one).select(
        F.col("hash").alias("component"), "family", "signature", "size", "pages", "instances", "first.page_id", "first.pos")
    families = kept.groupBy("family").agg(F.count("*").alias("variants"))
    return kept.join(families, "family")


def component_pages(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """``form_pages`` of an element table."""
    return form_pages(forms_per_page(nodes), inventory)


def form_pages(per_page: DataFrame, inventory: DataFrame) -> DataFrame:
    """Where each component of an inventory occurs: ``component, page_id, instances``."""
    found = per_page.select(F.col("hash").alias("component"), "page_id", F.col("n").alias("instances"))
    return found.join(inventory.select("component"), "component")
