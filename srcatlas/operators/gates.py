"""Items that a target's cfg leaves (C.2, D.1): gates act on all that is inside an item, across files too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cfg import evaluate
from ..plans.durable import durable
from ..plans.fixpoint import closure
from ..plans.interval import points_in_spans


def enabled_items(items: DataFrame, gates: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """C.2: target_id, file_id, item_id of the items that a target has.

    targets: target_id, root_file, atoms, pairs (key=value), is_test. An item goes if one of its gates is false, and with it
    what is inside it and the files that it alone links to. Files are first found by all links, so a gate is evaluated for
    the targets that can reach it, not for all; then by the links that stay. Links may form cycles.
    """
    start = targets.select("target_id", F.col("root_file").alias("file_id"))
    all_links = links.select("file_id", "item_id", "module_file")
    to_file = lambda rows: rows.select("target_id", F.col("module_file").alias("file_id"))
    reach = closure(start, lambda new: to_file(new.join(all_links, "file_id")))
    asked = gates.select("file_id", "item_id", "gate").join(reach, "file_id").join(targets.select("target_id", "atoms", "pairs", "is_test"), "target_id")
    off = asked.filter(~evaluate(F.parse_json("gate"), F.col("atoms"), F.col("pairs"), F.col("is_test"))).select("target_id", "file_id", "item_id").distinct()
    spans = off.join(items.select("file_id", "item_id", "span_start", "span_end"), ["file_id", "item_id"]).select("target_id", "file_id", "span_start", "span_end")
    points = items.select("file_id", "item_id", F.col("span_start").alias("at"))
    gone = durable(points_in_spans(points, spans, ["file_id"], at="at", closed=False).select("target_id", "file_id", "item_id").distinct(), "gone")
    own = ["target_id", "file_id", "item_id"]
    files = closure(start, lambda new: to_file(new.join(all_links, "file_id").join(gone, own, "left_anti")))
    return files.join(items.select("file_id", "item_id"), "file_id").select(own).join(gone, own, "left_anti")
