"""Per-book rule sets: shape of the configuration, and its ranges against the blocks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

try:
    import yaml
except ImportError:  # rule files alone need it
    yaml = None

# The keys and noise types that a rule set may name.
REQUIRED = ["slug", "title", "body_start_page", "appendices_start_page", "chapters", "section_re", "subsection_re", "heading_priority", "problem_start_re", "problem_chapter_must_match", "equation_strip_dollar", "equation_label_re"]
OPTIONAL = [
    "author", "edition", "subject", "publisher", "language", "filter_types", "ignore_image_content", "ignore_chart_content", "bibliography_start_page", "index_start_page", "inline_problems", "appendices", "problem_num_namespace_by_section",
    "problems_end_re", "solution_start_re", "problems_start_re", "suppress_running_header_sections", "example_start_re", "figure_caption_merge", "figure_caption_main_re", "known_missing_problems", "heading_text_level",
]
NOISE = {"header", "page_number", "footer", "page_footnote", "aside_text", "ref_text"}
GROUPS = {"section_re": 2, "subsection_re": 2, "problem_start_re": 1, "example_start_re": 1}


CHECKED = Ty.StructType([Ty.StructField("rule", Ty.StringType()), Ty.StructField("faults", Ty.ArrayType(Ty.StringType())), Ty.StructField("error", Ty.StringType())])


def faults(rule: dict) -> list[str]:
    """Everything wrong with one rule set that can be said without its blocks."""
    out = [f"missing {k}" for k in REQUIRED if k not in rule]
    out += [f"unknown {k}" for k in rule if k not in REQUIRED and k not in OPTIONAL]
    if rule.get("heading_priority") != ["subsection_re", "section_re"]:
        out.append("heading_priority")
    for k in [x for x in (*REQUIRED, *OPTIONAL) if x.endswith("_re") and rule.get(x)]:
        try:
            n = re.compile(rule[k]).groups
        except re.error:
            out.append(f"{k} does not compile")
            continue
        if k in GROUPS and n != GROUPS[k]:
            out.append(f"{k} needs {GROUPS[k]} groups")
    try:
        section = re.compile(rule.get("section_re") or r"(?!)()()")
        if section.groups == 2 and any((m := section.match(s)) and not (m.group(2) or "").strip() for s in ("1.1", "1.1 ", "4.1", "4.1 ", "10.5 ")):
            out.append("section_re takes bare numbers")
    except re.error:
        pass
    levels = rule.get("heading_text_level", 1)
    levels = levels if isinstance(levels, list) else [levels]
    if not levels or any(isinstance(x, bool) or not isinstance(x, int) or x < 1 for x in levels):
        out.append("heading_text_level")
    for k in ("inline_problems", "suppress_running_header_sections"):
        if k in rule and not isinstance(rule[k], bool):
            out.append(f"{k} is no boolean")
    out += [f"filter_types {x}" for x in sorted(set(rule.get("filter_types") or []) - NOISE)]
    for i, k in enumerate(rule.get("known_missing_problems") or []):
        if not (isinstance(k, dict) and isinstance(k.get("chapter"), int) and isinstance(k.get("nums"), list)):
            out.append(f"known_missing_problems {i}")
    nums = [c.get("num") for c in rule.get("chapters") or []]
    if nums and nums != list(range(nums[0], nums[0] + len(nums))):
        out.append("chapter numbers are not consecutive")
    return out


@F.pandas_udf(CHECKED)
def checked(files: pd.Series) -> pd.DataFrame:
    """A YAML text as JSON with its faults, or why it is no rule set; a scalar heading level becomes a list."""
    if yaml is None:
        raise ModuleNotFoundError("rule files are YAML: PyYAML is needed to read them")

    def one(text: str) -> tuple[str | None, list[str] | None, str | None]:
        try:
            rule = yaml.safe_load(text or "")
            if not isinstance(rule, dict):
                return None, None, "no mapping"
            wrong = faults(rule)
            levels = rule.get("heading_text_level", 1)
            return json.dumps(rule | {"heading_text_level": levels if isinstance(levels, list) else [levels]}, default=str), wrong, None
        except (yaml.YAMLError, AttributeError, TypeError, ValueError) as e:
            return None, None, f"does not parse: {type(e).__name__}"

    return pd.DataFrame([one(t) for t in files], columns=["rule", "faults", "error"])


def range_faults(chapters: DataFrame, sizes: DataFrame) -> DataFrame:
    """slug, num, fault: chapter indexes (start, problems, stop) against the number of blocks of the book."""
    c, p, s, n = (F.col(x) for x in ("start", "problems", "stop", "n_blocks"))

    def bad(cond: Column, name: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), name)

    checks = F.array_compact(
        F.array(bad((c < 0) | (c >= n), "start outside"), bad((s <= 0) | (s > n), "stop outside"), bad(c >= s, "start after stop"), bad((p <= c) | (p >= s), "problems outside"))
    )
    return chapters.join(sizes, "slug").select("slug", "num", F.explode(checks).alias("fault"))


def unanchored(chapters: DataFrame, blocks: DataFrame, start_re: str, heading_re: str) -> DataFrame:
    """Chapters without a problems index whose blocks hold both an item start and a problems heading."""
    inside = chapters.where("problems is null").join(blocks, "slug").where("idx > start and idx < stop")
    found = inside.groupBy("slug", "num").agg(F.bool_or(F.col("text").rlike(start_re)).alias("a"), F.bool_or((F.col("type") == "text") & F.trim("text").rlike(heading_re)).alias("b"))
    return found.where("a and b").select("slug", "num")
