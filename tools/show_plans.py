"""Write PLANS.md: the physical plans (operator tree, no expressions) of key operators
on the stand-in tables at sf0.01, straight from ``explain``.  Usage:
python tools/show_plans.py > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ricefield.operators import compare, ingest, rollups, search  # noqa: E402
from ricefield.plans import catalog  # noqa: E402
from ricefield.session import local_session  # noqa: E402
from ricefield.sources import driver_tables as dt  # noqa: E402

SF = "/root/testdata/sf0.01"


def tree(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in text.splitlines():
        m = re.match(r"^([\s:+\-|]*)(\*?\(\d+\)\s*)?([A-Za-z][A-Za-z]*)", line)
        if not m:
            continue
        name = m.group(3)
        extra = ""
        if name in ("Exchange",):
            extra = " " + re.sub(r"\(.*", "", line.split("Exchange", 1)[1].strip().split(",")[0])
        if name.endswith("Join"):
            kind = re.search(r"(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti)", line)
            extra = " " + (kind.group(1) if kind else "")
        if name == "FileScan" or name == "Scan":
            src = re.search(r"\[file:[^\]]*/([^/\]]+)\]", line)
            kind = re.search(r"Scan (\w+)", line)
            extra = " " + (src.group(1) if src else (kind.group(1) if kind else ""))
            pf = re.search(r"PartitionFilters: \[([^\]]*)\]", line)
            if pf and pf.group(1):
                extra += " PartitionFilters"
        out.append(m.group(1) + name + extra)
    return "\n".join(out)


def main():
    spark = local_session(8)
    t = catalog._t(spark, SF)
    cleaned = ingest.clean_upload(dt.upload_rows(spark, SF), keep=["season", "association_id", "line"])
    sections = [
        ("Municipality rollup (pre-aggregated, no Expand)", rollups.municipality_rollup(t)),
        ("Municipality merge for the season comparison (one aggregation by key)", compare.municipality_merge(t, "wet", "dry")),
        ("Highlights (max_by per metric and season)", compare.top_performers(compare.municipality_merge(t, "wet", "dry"), "wet", "dry")),
        ("Report page (top-k)", search.report_page(search.report_rows(t, search="customer"), 3)),
        ("Farmer list, first 100 per season (WindowGroupLimit before the joins)", search.farmer_list(t)),
        ("Season totals", rollups.season_summary(t, ["wet", "dry"])),
    ]
    print("# Physical plans of key operators\n")
    print("Generated by `tools/show_plans.py` on the sf0.01 stand-in tables (`local[8]`, AQE on;")
    print("initial plans, before AQE's runtime changes).  Operator tree only.\n")
    for title, df in sections:
        print(f"## {title}\n\n```\n{tree(df)}\n```\n")
    # the upload's key reduction, shown before the classification is checkpointed
    keyed = cleaned.where("NOT skipped AND key <> ''")
    from ricefield.functions.exprs import sql_key

    ex = dt.existing_farmers(spark, SF).select("season", sql_key("rsbsa").alias("key"))
    cut = ex.join(keyed.select("season", "key").distinct(), ["season", "key"], "left_semi")
    print("## Upload: table keys cut to the upload's keys (semi join)\n")
    print(f"```\n{tree(cut)}\n```\n")


if __name__ == "__main__":
    main()
