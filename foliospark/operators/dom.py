"""Trees of named nodes as rows: reading and writing XML, paths, edits, fields of forms.

A node is ``doc_id, id, parent_id, at, name, value``; ``at`` orders the children of a node,
``parent_id`` is null for a root.  Depths and paths come from the hierarchy operator, so trees
may have any depth and size; nodes in a ring have no path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as E
from .hierarchy import descendants, hierarchy

NODE = "doc_id bigint, id bigint, parent_id bigint, at int, name string, value string"
#: Bytes of one XML document at most.
LARGEST = 64 * 1024 * 1024

# The envelope of form packets.
XDP = ("xdp:xdp", "http://ns.adobe.com/xdp/")
# Positions of the bits of field flags, counted from 1.
FLAGS = {
    "read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "no_toggle_off": 15, "radio": 16, "push_button": 17, "combo": 18,
    "edit": 19, "sort": 20, "file_select": 21, "multi_select": 22, "comb": 25, "rich_text": 26,
}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, content in zip(batch["doc_id"], batch["content"]):
            if content is None or len(content) > LARGEST or "<!DOCTYPE" in content[:4096]:
                continue
            try:
                waiting = [(ElementTree.fromstring(content), None, 0)]
            except ElementTree.ParseError:
                continue
            n = 0
            while waiting:
                e, parent, at = waiting.pop()
                here, n = n, n + 1
                text = (e.text or "").strip() if len(e) == 0 else None
                rows.append((doc_id, here, parent, at, _local(e.tag), text))
                waiting += [(c, here, i) for i, c in reversed(list(enumerate(e)))]
        yield pd.DataFrame(rows, columns=["doc_id", "id", "parent_id", "at", "name", "value"]).astype({"parent_id": "Int64"})


def from_xml(documents: DataFrame) -> DataFrame:
    """Nodes of ``doc_id, content``; elements with children have no value.

    What is no XML, too large or declares a document type has no nodes.
    """
    return documents.select("doc_id", "content").mapInPandas(_parse, NODE)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for nodes in batch["nodes"]:
            below: dict = {}
            for n in nodes:
                below.setdefault(n["parent_id"], []).append(n)
            parts: list[str] = []
            waiting: list = list(reversed(below.get(None, [])))
            while waiting:
                n = waiting.pop()
                if isinstance(n, str):
                    parts.append(n)
                elif kids := below.get(n["id"]):
                    parts.append(f"<{n['name']}>")
                    waiting += [f"</{n['name']}>", *reversed(kids)]
                else:
                    parts.append(f"<{n['name']}>{escape(n['value'])}</{n['name']}>" if n["value"] else f"<{n['name']}/>")
            out.append("".join(parts))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "xml": out})


def to_xml(nodes: DataFrame) -> DataFrame:
    """``doc_id, xml``; nodes that hang on no root are left out.  One document fits a task."""
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "parent_id", "name", "value"))).alias("nodes"))
    return rows.mapInPandas(_write, "doc_id bigint, xml string")


def envelope(packets: DataFrame) -> DataFrame:
    """``doc_id, xdp``: the packets ``doc_id, at, xml`` of a document in their envelope."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "xml"))), lambda p: p["xml"]), "")
    head, tail = f"<{XDP[0]} xmlns:xdp={quoteattr(XDP[1])}>", f"</{XDP[0]}>"
    return packets.groupBy("doc_id").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("xdp"))


def packets(nodes: DataFrame) -> DataFrame:
    """The names of the packets an envelope holds: ``doc_id, at, name``."""
    roots = nodes.where("parent_id is null").select("doc_id", F.col("id").alias("parent_id"))
    return nodes.join(roots, ["doc_id", "parent_id"]).select("doc_id", "at", "name")


def _tree(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("doc_id").alias("entry_id"), F.col("id").cast("string").alias("style_id"), F.lit(None).cast("string").alias("name"),
        F.col("parent_id").cast("string").alias("based_on"), F.lit(0).alias("loaded_at"),
    )


def paths(nodes: DataFrame) -> DataFrame:
    """``doc_id, id, path``: names from the root with the number among the siblings of that name, as in ``form[0].row[2]``."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_id", "name").orderBy("at", "id")) - 1
    named = nodes.select("doc_id", F.col("id").alias("step"), F.concat("name", F.lit("["), nth.cast("string"), F.lit("]")).alias("part"))
    tree = hierarchy(_tree(nodes), with_path=True).where("depth >= 0")
    steps = tree.select(F.col("entry_id").alias("doc_id"), F.col("style_id").cast("bigint").alias("id"), F.posexplode("path").alias("pos", "step")).withColumn("step", F.col("step").cast("bigint"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return steps.join(named, ["doc_id", "step"]).groupBy("doc_id", "id").agg(F.array_join(ordered, ".").alias("path"))


def path_pattern(path: str) -> str:
    """The paths that an expression such as ``form.row[*].total`` means, as a regular expression.

    A name without number means the first of that name, ``[*]`` all of them, ``*`` any name.
    """
    out = []
    for segment in path.split("."):
        m = re.fullmatch(r"(\*|[^\[\]*]+)(?:\[(\d+|\*)\])?", segment)
        if not m:
            raise ValueError(f"bad path segment: {segment!r}")
        name, at = m.groups()
        number = r"\d+" if at == "*" or (name == "*" and at is None) else at or "0"
        out.append((r"[^.\[]+" if name == "*" else re.escape(name)) + rf"\[{number}\]")
    return "^" + r"\.".join(out) + "$"


def resolve(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes an expression means, with their ``path``; none is an empty result."""
    return nodes.join(paths(nodes).where(F.col("path").rlike(path_pattern(path))), ["doc_id", "id"])


def resolve_single(nodes: DataFrame, path: str) -> DataFrame:
    """``doc_id, id, value`` of the one node that an expression means in each document; several are an error when the row is read."""
    found = resolve(nodes, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "value")).alias("t"))
    several = F.raise_error(F.concat(F.lit(f"{path} means several nodes in document "), F.col("doc_id").cast("string"))).cast("bigint")
    return found.select("doc_id", F.when(F.col("n") == 1, F.col("t.id")).otherwise(several).alias("id"), "t.value")


def remove(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without those in ``gone`` (``doc_id, id``) and what hangs below them."""
    below = descendants(_tree(nodes)).select(F.col("entry_id").alias("doc_id"), F.col("ancestor_id").cast("bigint").alias("id"), F.col("style_id").cast("bigint").alias("low"))
    all_gone = gone.select("doc_id", "id").unionByName(below.join(gone.select("doc_id", "id"), ["doc_id", "id"], "left_semi").select("doc_id", F.col("low").alias("id"))).distinct()
    return nodes.join(all_gone, ["doc_id", "id"], "left_anti")


def rename(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes with the new names of ``doc_id, id, new_name``; one name a node."""
    return nodes.join(names, ["doc_id", "id"], "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def insert(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with the rows of ``more`` put in: later siblings move up by one for each node put before them."""
    keys = more.select("doc_id", F.col("parent_id").alias("_p"), F.col("at").alias("_at"))
    shifts = nodes.join(keys, (nodes["doc_id"] == keys["doc_id"]) & nodes["parent_id"].eqNullSafe(keys["_p"]) & (nodes["at"] >= keys["_at"])).groupBy(nodes["doc_id"], nodes["id"]).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    moved = nodes.join(shifts, ["doc_id", "id"], "left").withColumn("at", F.col("at") + F.coalesce("_n", F.lit(0))).drop("_n")
    return moved.unionByName(more.select(*moved.columns))


def move(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes hung below another parent by ``doc_id, id, new_parent, new_at``; a move below itself or a descendant is left out."""
    below = descendants(_tree(nodes)).select(F.col("entry_id").alias("doc_id"), F.col("ancestor_id").cast("bigint").alias("id"), F.col("style_id").cast("bigint").alias("new_parent"))
    sound = moves.where("id <> new_parent").join(below, ["doc_id", "id", "new_parent"], "left_anti").withColumn("_moved", F.lit(True))
    found = nodes.join(sound, ["doc_id", "id"], "left")
    at = lambda new, old: F.when(F.col("_moved"), F.col(new)).otherwise(F.col(old))
    return found.withColumn("parent_id", at("new_parent", "parent_id")).withColumn("at", at("new_at", "at")).drop("new_parent", "new_at", "_moved")


def set_values(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Nodes with the values of ``doc_id, path, new_value`` put at their paths; paths that are not there change nothing."""
    at = paths(nodes).join(values, ["doc_id", "path"]).select("doc_id", "id", F.struct("new_value").alias("_new"))
    return nodes.join(at, ["doc_id", "id"], "left").withColumn("value", F.when(F.col("_new").isNotNull(), F.col("_new.new_value")).otherwise(F.col("value"))).drop("_new")


def flag(flags: Column, name: str) -> Column:
    """Whether a field has a flag; missing flags are 0."""
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(1 << (FLAGS[name] - 1))) != 0


def field_kind(kind: Column, flags: Column) -> Column:
    """What a field of type Tx, Btn, Ch or Sig is: 'text', 'password', 'check', 'radio', 'push', 'list', 'combo', 'signature' and so on."""
    is_ = lambda name: flag(flags, name)
    return (
        F.when(kind == "Tx", F.when(is_("password"), "password").when(is_("file_select"), "file").when(is_("rich_text"), "rich").when(is_("comb") & ~is_("multiline"), "comb").when(is_("multiline"), "multiline").otherwise("text"))
        .when(kind == "Btn", F.when(is_("push_button"), "push").when(is_("radio"), "radio").otherwise("check"))
        .when(kind == "Ch", F.when(is_("combo"), "combo").otherwise("list"))
        .when(kind == "Sig", "signature")
    )


def comb_width(width: Column, signs: Column) -> Column:
    """The width of one place of a comb; null without a number of signs."""
    return F.when(signs > 0, width / signs)


def toggled(value: Column, on: Column, kind: Column, flags: Column) -> Column:
    """The state of a check box or radio button after a click: radio buttons that may not be switched off stay on."""
    stays = (kind == "radio") & flag(flags, "no_toggle_off")
    return F.when((value == on) & ~stays, "Off").otherwise(on)


def radio_states(buttons: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, name, on, state``: of the buttons ``doc_id, name, on`` of a group the ``chosen`` one is on; an unknown choice switches all off."""
    picked = chosen.select("doc_id", "name", F.col("on").alias("_on"))
    return buttons.join(picked, ["doc_id", "name"], "left").select("doc_id", "name", "on", F.when(F.col("on") == F.col("_on"), F.col("on")).otherwise("Off").alias("state"))


def chosen_options(options: Column, wanted: Column, flags: Column) -> Column:
    """The wanted values that are among the options, in their order; only the first one unless several may be chosen."""
    known = F.filter(options, lambda o: F.array_contains(wanted, o))
    return F.when(flag(flags, "multi_select"), known).otherwise(F.slice(known, 1, 1))


def _calculate(batches: Iterator[pd.DataFrame], rounds: int) -> Iterator[pd.DataFrame]:
    parsed: dict[str, object] = {}
    for batch in batches:
        rows = []
        for doc_id, values, scripts in zip(batch["doc_id"], batch["nodes"], batch["scripts"]):
            tree = {v["path"]: v["value"] for v in values}
            errors: dict[str, str] = {}
            for _ in range(rounds):
                before = dict(tree)
                for s in scripts if scripts is not None else ():
                    if s["path"] not in tree:
                        continue
                    beside = s["path"].rpartition(".")[0]
                    fields = {p.rpartition(".")[2].partition("[")[0]: v for p, v in reversed(tree.items()) if p.rpartition(".")[0] == beside}
                    try:
                        node = parsed.get(s["script"]) or parsed.setdefault(s["script"], E.parse(s["script"]))
                        value = E.Interpreter(fields, tree).run(node)
                        tree[s["path"]] = None if value is None else E.string(value)
                        errors.pop(s["path"], None)
                    except (E.ScriptError, RecursionError) as e:
                        errors[s["path"]] = str(e)
                if tree == before:
                    break
            rows += [(doc_id, p, v, errors.get(p)) for p, v in tree.items()]
        yield pd.DataFrame(rows, columns=["doc_id", "path", "value", "error"])


def calculated(nodes: DataFrame, scripts: DataFrame, rounds: int = 10) -> DataFrame:
    """``doc_id, path, value, error``: the values of forms after their calculations.

    ``scripts`` are ``doc_id, path, at, script``; they run in the order of ``at`` and all again
    until nothing changes, ``rounds`` times at most.  A script sees the fields beside its own
    by name and all others by path; one that fails leaves its value and has an error.
    """
    placed = nodes.join(paths(nodes), ["doc_id", "id"])
    values = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("nodes"))  # one form
    ordered = scripts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "path", "script"))).alias("scripts"))
    return values.join(ordered, "doc_id", "left").mapInPandas(lambda it: _calculate(it, rounds), "doc_id bigint, path string, value string, error string")


def invalid(nodes: DataFrame, scripts: DataFrame) -> DataFrame:
    """``doc_id, path``: fields whose validation ``doc_id, path, at, script`` gives something false, as conditions of scripts do.

    A script that fails or gives nothing does not make a field invalid.
    """
    checks = scripts.select("doc_id", "path", "at", "script")
    marked = calculated(nodes, checks, 1)
    tested = marked.join(checks.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_semi").where("error is null and value is not null")
    number = F.col("value").try_cast("double")
    return tested.where(F.when(number.isNotNull(), number == 0).otherwise(F.trim("value") == "")).select("doc_id", "path")
