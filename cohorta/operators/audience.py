"""Front door: rules or trees -> filtered audience, counts and reports.

``prepare`` lowers business rules to a tree, attaches the block-file flag
columns the tree needs (one join for all block rules, however many), and
compiles the tree to a single Column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.operators import blocks as B
from cohorta.operators.filters import FilterCompiler, FilterError, flat_values_tree
from cohorta.operators.paging import page, resolve_select, sort_keys
from cohorta.operators.rules import block_id_sets, is_rule_shape, rules_to_tree
from cohorta.operators.stats import campaign_stats, scope
from cohorta.schema import Catalog


def to_tree(spec, catalog: Catalog, segment_defs=None, block_match_field: str = "f2") -> dict:
    """Accepts a tree, a rule list or ``{"values": {...}}``."""
    if spec is None:
        return {"op": "and", "children": []}
    if isinstance(spec, dict) and "values" in spec and "op" not in spec:
        return flat_values_tree(spec["values"])
    if isinstance(spec, list):
        if spec and not is_rule_shape(spec):
            raise FilterError("a filter list must hold rules or groups of rules")
        return rules_to_tree(spec, catalog, segment_defs, block_match_field)
    return spec


def prepare(df: DataFrame, trees: list[dict], catalog: Catalog, blocks: DataFrame | None = None,
            block_match_field: str = "f2", as_of_epoch: int | None = None, strict_dates: bool = False):
    """Returns (frame with block flags, compiler)."""
    sets = []
    for t in trees:
        for s in block_id_sets(t):
            if s not in sets:
                sets.append(s)
    if sets:
        if blocks is None:
            raise FilterError("block file rules need block data (blocks=...)")
        df = B.add_block_flags(df, blocks, sets, block_match_field)
    comp = FilterCompiler(catalog, {f.name: f.dataType for f in df.schema.fields},
                          as_of_epoch=as_of_epoch, strict_dates=strict_dates,
                          block_flag=B.flag_name if sets or blocks is not None else None)
    return df, comp


def audience(df: DataFrame, spec, catalog: Catalog, *, segment_defs=None, blocks=None,
             block_match_field: str = "f2", as_of_epoch: int | None = None,
             account_id: int | None = None, deleted: str = "strict") -> DataFrame:
    """Rows in scope for which the filter is TRUE (flag columns dropped)."""
    tree = to_tree(spec, catalog, segment_defs, block_match_field)
    if account_id is None and isinstance(spec, dict) and "op" not in spec:
        account_id = (spec.get("values") or {}).get("account_id")    # flat values may name their account
    base = scope(df, account_id, deleted)
    cols = base.columns
    fdf, comp = prepare(base, [tree], catalog, blocks, block_match_field, as_of_epoch)
    return fdf.filter(comp.compile(tree)).select(*cols)


def parse_query(df: DataFrame, request: dict, catalog: Catalog, blocks: DataFrame | None = None):
    """Request dict (account_id, filter|values, include_deleted, select, order_by,
    order_dir, limit, offset, segment_defs, block_match_field) ->
    (rows DataFrame, count DataFrame)."""
    account_id = int(request.get("account_id") or 0)
    if account_id <= 0:
        raise FilterError("account_id is required and must be > 0")
    if "filter" in request and request["filter"] is not None:
        spec = request["filter"]
    else:
        spec = {"values": request.get("values") or {}}
    deleted = "include" if request.get("include_deleted") else "strict"
    rows = audience(df, spec, catalog, segment_defs=request.get("segment_defs"), blocks=blocks,
                    block_match_field=request.get("block_match_field", "f2"),
                    as_of_epoch=request.get("as_of_epoch"), account_id=account_id, deleted=deleted)
    count = rows.agg(F.count(F.lit(1)).alias("cnt"))
    columns = resolve_select(request.get("select"), catalog.names())
    order_by, order_dir = request.get("order_by"), request.get("order_dir") or "ASC"
    if order_by and catalog.get(order_by) is None:
        raise FilterError(f"order_by: no column {order_by!r}")
    out = rows
    if request.get("limit") is not None:
        out = page(rows, order_by or "id", order_dir, int(request["limit"]), int(request.get("offset") or 0), tie="id")
    elif order_by:
        out = rows.orderBy(*sort_keys(order_by, order_dir, "id"))
    return out.select(*columns), count


def campaign_report(df: DataFrame, include, exclude, catalog: Catalog, *, segment_defs=None,
                    blocks=None, block_match_field: str = "f2", as_of_epoch: int | None = None,
                    account_id: int | None = None, by=(), deleted: str = "strict") -> DataFrame:
    """Campaign statistics for include / exclude rules (one pass, one flag join)."""
    inc = to_tree(include, catalog, segment_defs, block_match_field)
    exc = to_tree(exclude, catalog, segment_defs, block_match_field) if exclude else None
    base = scope(df, account_id, deleted)
    trees = [inc] + ([exc] if exc else [])
    fdf, comp = prepare(base, trees, catalog, blocks, block_match_field, as_of_epoch)
    inc_c: Column = comp.compile(inc)
    exc_c = comp.compile(exc) if exc else None
    return campaign_stats(fdf, inc_c, exc_c, by=by)
