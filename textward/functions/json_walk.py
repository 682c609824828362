"""Walks through JSON of any depth as one column expression over VARIANT.

A fold goes down level by level with the containers of one level as its state, and stops early: levels behind
the last one cost nothing. Flat documents take one step, nothing leaves the engine, and the number of steps is the
number of opening brackets at most (the parser itself refuses more than 1,000 levels).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<struct<path:string,key:string,value:variant>>"
LEAVES = "array<struct<path:string,key:string,text:string>>"
DEEPEST = 1001

# Children of the containers among `nodes`; array items take their array's key if asked to.
CHILDREN = """flatten(transform({nodes}, n -> CASE
  WHEN startswith(schema_of_variant(n.value), 'OBJECT') THEN transform(
    map_entries(try_variant_get(n.value, '$', 'map<string,variant>')),
    e -> named_struct('path', concat(n.path, '/', e.key), 'key', e.key, 'value', e.value))
  WHEN startswith(schema_of_variant(n.value), 'ARRAY') THEN transform(
    try_variant_get(n.value, '$', 'array<variant>'), (v, i) -> named_struct(
      'path', concat(n.path, '/', lpad(CAST(i AS string), 6, '0')), 'key', {item_key}, 'value', v))
  ELSE CAST(array() AS {type}) END))"""
CONTAINER = "schema_of_variant({n}.value) RLIKE '^(OBJECT|ARRAY)'"
STRINGS = """transform(filter({nodes}, s -> schema_of_variant(s.value) = 'STRING'),
  s -> named_struct('path', s.path, 'key', s.key, 'text', try_variant_get(s.value, '$', 'string')))"""


def children(nodes: str, inherit: bool = False) -> str:
    return CHILDREN.format(nodes=nodes, item_key="n.key" if inherit else "''", type=NODES)


def root_nodes(root: str) -> str:
    """The root as the only node, none for NULL."""
    return f"CASE WHEN {root} IS NULL THEN CAST(array() AS {NODES}) ELSE CAST(array(named_struct('path', '', 'key', '', 'value', {root})) AS {NODES}) END"


def string_leaves(root: str, text: str, inherit: bool = False) -> Column:
    """All string leaves below the root as (path, key, text); `text` is the column that `root` was parsed from."""
    state = f"struct<nodes:{NODES},leaves:{LEAVES}>"
    steps = f"least(length({text}) - length(translate({text}, '[{{', '')), {DEEPEST})"
    below = children("acc.nodes", inherit)
    step = f"""transform(array({below}), ch -> CAST(named_struct(
      'nodes', filter(ch, x -> {CONTAINER.format(n='x')}), 'leaves', concat(acc.leaves, {STRINGS.format(nodes='ch')})) AS {state}))[0]"""
    start = f"CAST(named_struct('nodes', {root_nodes(root)}, 'leaves', CAST(array() AS {LEAVES})) AS {state})"
    return F.expr(
        f"""CASE WHEN {root} IS NULL OR {steps} = 0 THEN CAST(array() AS {LEAVES}) ELSE aggregate(sequence(1, {steps}), {start},
        (acc, i) -> CASE WHEN size(acc.nodes) = 0 THEN acc ELSE {step} END, acc -> acc.leaves) END"""
    )


def first_object(root: str, condition: str, max_depth: int) -> Column:
    """Struct (`hit`, `nodes`, `too_deep`): the first object on the highest level with `condition` on `h.value`.

    Objects that meet the condition are not searched further. `nodes` counts what was visited, `too_deep` says that
    nodes are left below `max_depth` levels.
    """
    state = f"struct<level:{NODES},hit:variant,nodes:bigint>"
    rest = children(f"filter(acc.level, h -> NOT ({condition}))")
    step = f"""CAST(named_struct('level', {rest}, 'hit', coalesce(acc.hit, get(filter(acc.level, h -> {condition}), 0).value),
      'nodes', acc.nodes + size(acc.level)) AS {state})"""
    start = f"CAST(named_struct('level', {root_nodes(root)}, 'hit', CAST(NULL AS variant), 'nodes', 0L) AS {state})"
    return F.expr(
        f"""aggregate(sequence(0, {max_depth}), {start}, (acc, i) -> CASE WHEN size(acc.level) = 0 THEN acc ELSE {step} END,
        acc -> named_struct('hit', acc.hit, 'nodes', acc.nodes, 'too_deep', size(acc.level) > 0))"""
    )
