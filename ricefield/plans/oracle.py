"""DuckDB SQL for every registered query (the correctness oracle).

Each statement rebuilds the model tables from the driver's views with the same
mapping as ``sources.driver_tables`` (``MODEL_SQL``) and states the rules of SURVEY once
more in SQL; patterns, marks and column maps are written out here and not taken from the
library's code.
"""

from __future__ import annotations

from ricefield.plans import catalog as C
from ricefield.sources.driver_tables import ASSOCIATION_REQUESTS_SQL, MODEL_SQL, UPLOAD_CUTOFF, UPLOAD_SQL

# Seed varieties in order; cell texts of the stand-in sheet that mean
# "missing"; export columns and the farmer field under each.
SEED_VARIETIES = ["Bigante", "Lp2096", "Nk 5017", "S6003", "SL 20", "SL 19", "JACKPOT", "SL 8", "TH 82"]
MISSING = ["", "nan", "n/a"]
TEMPLATE_COLUMNS = {
    "ffrs_rsbsa_number": "rsbsa", "farmer_last_name": "last_name", "farmer_first_name": "first_name",
    "farmer_middle_name": "middle_name", "farmer_ext_name": "suffix", "farm_address_province": "",
    "farm_address_municipality": "", "seed_variety_claimed": "variety", "claimed_area_ha": "area", "claimed_seeds_kg": "",
    "lot_series": "", "sex": "", "birthdate": "", "contact_number": "", "crop_establishment": "", "eco_system": "",
    "eco_system_source": "", "date_of_sowing": "", "average_weight_per_bag_kg_for_all_variety_ies": "kg",
    "total_production_no_of_bags_for_all_variety_ies": "sacks", "average_area_harvested_ha": "area",
    "seed_variety_planted": "variety", "seed_class_hybrid_inbred_etc": "",
}
SHORT_COLUMNS = {
    "id": "id", "rsbsa": "rsbsa", "last_name": "last_name", "first_name": "first_name", "middle_name": "middle_name",
    "suffix": "suffix", "area_ha": "area", "variety": "variety", "sacks": "sacks", "kilograms": "kg",
}

Z = "CAST(0 AS DOUBLE)"


def R2(x: str) -> str:
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def RATIO0(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) <> 0 THEN {R2(f'({n}) / ({d})')} ELSE {Z} END)"


def PCT(old: str, new: str) -> str:
    return (
        f"(CASE WHEN ({old}) = 0 THEN (CASE WHEN ({new}) = 0 THEN {Z} ELSE CAST(NULL AS DOUBLE) END) "
        f"ELSE {R2(f'(({new}) - ({old})) / ({old}) * 100')} END)"
    )


def TREND(d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN 'increased' WHEN ({d}) < 0 THEN 'decreased' ELSE 'no change' END)"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def PYKEY(x: str) -> str:
    return f"lower({STRIP(x)})"


def LIKE(col: str, term: str) -> str:
    return f"coalesce({col} ILIKE '%{term}%', false)"


_MISSING = ", ".join(f"'{t}'" for t in MISSING)
DECIMAL = "[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[-+]?[0-9]+)?"
GROUPED = "[-+]?[0-9][0-9_]*([.][0-9_]*)?(e[-+]?[0-9]+)?"


def TEXT(x: str) -> str:
    return f"coalesce({STRIP(f'CASE WHEN {x} NOT IN ({_MISSING}) THEN {x} END')}, '')"


def NUM(x: str) -> str:
    """A cell's number, 0 for anything else."""
    return f"(CASE WHEN regexp_full_match(lower(trim({x})), '{DECIMAL}') THEN CAST(trim({x}) AS DOUBLE) ELSE {Z} END)"


def FORMNUM(x: str) -> str:
    """A typed number, 0 when nothing was typed, NULL when it can't be read."""
    return (
        f"(CASE coalesce({x}, '') WHEN '' THEN {Z} ELSE "
        f"CASE WHEN regexp_full_match(lower(trim({x})), '{GROUPED}') THEN TRY_CAST(replace(trim({x}), '_', '') AS DOUBLE) END END)"
    )


def W(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return f"WITH {MODEL_SQL}{extra}\n{body}"


SEASON_TOT = """
seasons(season) AS (VALUES ('wet'), ('dry')),
mc AS (SELECT season, count(*) AS c FROM muni GROUP BY season),
ac AS (SELECT season, count(*) AS c FROM assoc GROUP BY season),
fc AS (SELECT season, count(*) AS c, sum(area) AS area, sum(sacks) AS sacks, sum(sacks * kg) AS kg
       FROM farmer GROUP BY season),
tot AS (
    SELECT s.season, coalesce(mc.c, 0) AS municipalities, coalesce(ac.c, 0) AS associations,
           coalesce(fc.c, 0) AS farmers, coalesce(fc.area, 0) AS area, coalesce(fc.sacks, 0) AS sacks,
           coalesce(fc.kg, 0) AS kg
    FROM seasons s LEFT JOIN mc ON mc.season = s.season LEFT JOIN ac ON ac.season = s.season
    LEFT JOIN fc ON fc.season = s.season
),
summ AS (
    SELECT season, municipalities, associations, farmers,
           """ + R2("area") + """ AS area, """ + R2("kg / 1000.0::DOUBLE") + """ AS mt
    FROM tot
),
b AS (SELECT * FROM summ WHERE season = 'wet'),
c AS (SELECT * FROM summ WHERE season = 'dry')"""

MUNI_ROLLUP = """
mr AS (
    SELECT m.season, m.id, m.name, count(DISTINCT a.id) AS associations, count(DISTINCT f.id) AS farmers,
           """ + R2("coalesce(sum(f.area), 0)") + """ AS area,
           """ + R2("coalesce(sum(f.sacks * f.kg), 0) / 1000.0::DOUBLE") + """ AS mt
    FROM muni m
    LEFT JOIN assoc a ON a.season = m.season AND a.municipality_id = m.id
    LEFT JOIN farmer f ON f.season = a.season AND f.association_id = a.id
    GROUP BY m.season, m.id, m.name
)"""

MUNI_CMP = MUNI_ROLLUP + """,
side AS (
    SELECT season, """ + PYKEY("name") + """ AS key,
           arg_max(name, id) AS l_name, arg_max(associations, id) AS l_assoc, arg_max(farmers, id) AS l_farmers,
           arg_max(area, id) AS l_area, arg_max(mt, id) AS l_mt, arg_min(name, id) AS first_name, min(id) AS first_id
    FROM mr GROUP BY season, """ + PYKEY("name") + """
),
bs AS (SELECT * FROM side WHERE season = 'wet'),
cs AS (SELECT * FROM side WHERE season = 'dry'),
j AS (
    SELECT CASE WHEN bs.key IS NOT NULL THEN bs.l_name ELSE cs.first_name END AS municipality,
           coalesce(bs.l_assoc, 0) AS base_associations, coalesce(cs.l_assoc, 0) AS current_associations,
           coalesce(bs.l_farmers, 0) AS base_farmers, coalesce(cs.l_farmers, 0) AS current_farmers,
           coalesce(bs.l_area, 0) AS base_area, coalesce(cs.l_area, 0) AS current_area,
           coalesce(bs.l_mt, 0) AS base_mt, coalesce(cs.l_mt, 0) AS current_mt,
           CASE WHEN bs.key IS NOT NULL THEN 0 ELSE 1 END AS src_rank,
           CASE WHEN bs.key IS NOT NULL THEN bs.first_id ELSE cs.first_id END AS src_id
    FROM bs FULL OUTER JOIN cs ON bs.key = cs.key
),
cmp AS (
    SELECT municipality, base_associations, current_associations, base_farmers, current_farmers,
           base_area, current_area, base_mt, current_mt,
           """ + R2("current_mt - base_mt") + """ AS difference, """ + PCT("base_mt", "current_mt") + """ AS change,
           row_number() OVER (ORDER BY current_mt DESC, src_rank, src_id) AS pos
    FROM j
)"""


# Every association with its municipality's name and what its farmers made.
PLACES = """
made AS (
    SELECT season, association_id, count(*) AS n, sum(area) AS area, sum(sacks * kg) AS kg FROM farmer GROUP BY ALL
),
place AS (
    SELECT assoc.season, assoc.id AS association_id, muni.name AS town, assoc.name AS coop,
           row(lower(trim(muni.name)), lower(trim(assoc.name))) AS pair,
           coalesce(made.n, 0) AS n, coalesce(made.area, 0) AS area, coalesce(made.kg, 0) / 1000.0::DOUBLE AS mt
    FROM assoc
    JOIN muni ON row(muni.season, muni.id) = row(assoc.season, assoc.municipality_id)
    LEFT JOIN made ON row(made.season, made.association_id) = row(assoc.season, assoc.id)
)"""

REPORT_ROWS = PLACES + f""",
rows_ AS (
    SELECT upper(left(season, 1)) || substr(season, 2) AS season, id,
           trim(concat(last_name, ', ', first_name, ' ', middle_name)) AS farmer_name,
           town AS municipality, coop AS association, coalesce(farmer.area, 0) AS area_hectares,
           coalesce(sacks * kg, 0) / 1000.0::DOUBLE AS estimated_yield_tons, 'Active' AS status
    FROM farmer JOIN place USING (season, association_id)
),
filtered AS (
    SELECT * FROM rows_
    WHERE {LIKE('municipality', C.REPORT_MUNICIPALITY)}
      AND ({LIKE('farmer_name', C.REPORT_SEARCH)} OR {LIKE('association', C.REPORT_SEARCH)})
),
stats AS (
    SELECT count(*) AS total_records, {R2('coalesce(sum(area_hectares), 0)')} AS total_area,
           {R2('coalesce(sum(estimated_yield_tons), 0)')} AS total_yield
    FROM filtered
)"""

FARMER_COLS = "season, id, association_id, rsbsa, last_name, first_name, middle_name, suffix, area, variety, sacks, kg"
FARMER_COLS_F = ", ".join("f." + c.strip() for c in FARMER_COLS.split(","))

UPLOAD_CLEAN = f"""
clean AS (
    SELECT season, association_id, line,
           {TEXT('rsbsa_text')} AS rsbsa, {TEXT('last_text')} AS last_name, {TEXT('first_text')} AS first_name,
           {TEXT('middle_text')} AS middle_name, {TEXT('ext_text')} AS suffix,
           {NUM('area_text')} AS area,
           CASE WHEN {TEXT('claimed_text')} <> '' THEN {TEXT('claimed_text')}
                WHEN {TEXT('planted_text')} <> '' THEN {TEXT('planted_text')} ELSE '' END AS variety,
           {NUM('sacks_text')} AS sacks, {NUM('kg_text')} AS kg
    FROM upload_src
),
k AS (SELECT *, lower(rsbsa) AS key, (last_name = '' AND first_name = '') AS skipped FROM clean),
judged AS (
    SELECT k.*,
           CASE WHEN k.skipped THEN 'skipped'
                WHEN k.key = '' THEN 'inserted'
                WHEN EXISTS (SELECT 1 FROM existing e WHERE e.season = k.season
                                AND (k.season = 'wet' OR e.association_id = k.association_id)
                                AND lower(trim(e.rsbsa)) = k.key) THEN 'duplicate'
                WHEN EXISTS (SELECT 1 FROM k k2 WHERE k2.season = k.season
                                AND (k.season = 'wet' OR k2.association_id = k.association_id)
                                AND k2.key = k.key AND NOT k2.skipped AND k2.line < k.line) THEN 'duplicate'
                ELSE 'inserted' END AS status
    FROM k
),
maxid AS (SELECT season, max(id) AS m FROM existing GROUP BY season),
classified AS (
    SELECT j.season, j.association_id, j.line, j.rsbsa, j.last_name, j.first_name, j.middle_name, j.suffix,
           j.area, j.variety, j.sacks, j.kg, j.status,
           CASE WHEN j.status = 'inserted'
                THEN coalesce(mx.m, 0) + row_number() OVER (PARTITION BY j.season, j.status = 'inserted' ORDER BY j.line)
           END AS id
    FROM judged j LEFT JOIN maxid mx ON mx.season = j.season
)"""


TYPED_SACKS = """CASE o_orderkey % 13 WHEN 0 THEN 'x' WHEN 1 THEN '12d' WHEN 2 THEN '   ' WHEN 3 THEN '1_0' WHEN 4 THEN ''
                WHEN 5 THEN ' 1.5e1 ' ELSE CAST(o_orderkey % 50 AS VARCHAR) END"""

FORM_INSERTS = f"""
fi AS (
    SELECT season, association_id, id AS line, rsbsa, ' ' || last_name AS last_name, first_name, middle_name, suffix,
           CAST(o_orderkey % 7 AS VARCHAR) AS area, variety, {TYPED_SACKS} AS sacks,
           CASE WHEN kg IS NULL THEN NULL ELSE CAST(CAST(kg AS BIGINT) AS VARCHAR) END AS kg
    FROM farmer_src WHERE o_orderdate >= TIMESTAMP '{UPLOAD_CUTOFF}'
),
existing AS (
    SELECT {FARMER_COLS} FROM farmer_src WHERE o_orderdate < TIMESTAMP '{UPLOAD_CUTOFF}'
)"""


def _typed(src: str, keep: str) -> str:
    texts = ", ".join(
        f"coalesce({STRIP(c)}, '') AS {c}" for c in ["rsbsa", "last_name", "first_name", "middle_name", "suffix", "variety"]
    )
    nums = ", ".join(f"{FORMNUM(c)} AS {c}" for c in ["area", "sacks", "kg"])
    valid = " AND ".join(f"{FORMNUM(c)} IS NOT NULL" for c in ["area", "sacks", "kg"])
    return f"SELECT {keep}, {texts}, {nums}, ({valid}) AS valid FROM {src}"


EDITS = f"""
e1 AS (
    SELECT season, id + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000 ELSE 0 END AS id, id * 2 AS line,
           upper(trim(rsbsa)) AS rsbsa, ' ' || lower(last_name) || ' ' AS last_name, first_name, '' AS middle_name,
           'Jr.' AS suffix, CAST(o_orderkey % 9 AS VARCHAR) AS area, 'SL 19' AS variety, {TYPED_SACKS} AS sacks, '' AS kg,
           o_orderkey % 7 = 0 AS twice
    FROM farmer_src WHERE o_orderpriority = '1-URGENT'
),
ed AS (
    SELECT * EXCLUDE (twice) FROM e1
    UNION ALL
    SELECT * EXCLUDE (twice) REPLACE (line + 1 AS line, 'Sr.' AS suffix, '7' AS sacks) FROM e1 WHERE twice
),
typed AS ({_typed('ed', 'season, id, line')}),
winner AS (SELECT * FROM typed WHERE valid QUALIFY row_number() OVER (PARTITION BY season, id ORDER BY line DESC) = 1)"""


def _rows(tables: dict[str, str]) -> str:
    """All rows of model tables in one shape."""
    parts = []
    for name, rel in tables.items():
        parent = {"association": "municipality_id", "farmer": "association_id"}.get(name, "CAST(NULL AS BIGINT)")
        if name == "farmer":
            rest = "concat_ws('|', rsbsa, last_name, first_name, middle_name, suffix, variety) AS name, area, sacks, kg"
        else:
            rest = "name, CAST(NULL AS DOUBLE) AS area, CAST(NULL AS DOUBLE) AS sacks, CAST(NULL AS DOUBLE) AS kg"
        parts.append(f"SELECT '{name}' AS table_name, season, id, CAST({parent} AS BIGINT) AS parent_id, {rest} FROM {rel}")
    return "\nUNION ALL\n".join(parts)


ASSOC_PROPOSALS = """
props AS (
    SELECT s.season, CAST(s_nationkey AS BIGINT) AS municipality_id,
           CASE WHEN s_acctbal < 0 THEN '  ' ELSE s_name END AS name, 0 AS src, CAST(s_suppkey AS BIGINT) AS line
    FROM supplier, (VALUES ('wet'), ('dry')) s(season)
    UNION ALL
    SELECT s.season, CAST(s_nationkey AS BIGINT), upper(s_name), 1, CAST(s_suppkey AS BIGINT)
    FROM supplier, (VALUES ('wet'), ('dry')) s(season)
    UNION ALL
    SELECT s.season, CAST(c_nationkey AS BIGINT), lower(c_name) || '  ', 2, CAST(c_custkey AS BIGINT)
    FROM customer, (VALUES ('wet'), ('dry')) s(season) WHERE c_acctbal < 0
)"""

MUNI_PROPOSALS = """
props AS (
    SELECT s.season, CASE WHEN r_regionkey = 0 THEN ' ' ELSE
               upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) END AS name,
           0 AS src, CAST(r_regionkey AS BIGINT) AS line
    FROM region, (VALUES ('wet'), ('dry')) s(season)
    UNION ALL
    SELECT s.season, upper(r_name), 1, CAST(r_regionkey AS BIGINT) FROM region, (VALUES ('wet'), ('dry')) s(season)
    UNION ALL
    SELECT s.season, lower(n_name), 2, CAST(n_nationkey AS BIGINT) FROM nation, (VALUES ('wet'), ('dry')) s(season)
)"""


def _add_sql(props: str, table: str, scope: list[str], unique: bool, cols: str) -> str:
    same = " AND ".join(f"x.{c} = p.{c}" for c in scope)
    if unique:
        dup = f"""EXISTS (SELECT 1 FROM {table} x WHERE {same} AND lower(trim(x.name)) = p.key)
               OR EXISTS (SELECT 1 FROM p2 x WHERE {same} AND x.key = p.key AND x.name <> ''
                          AND (x.src < p.src OR (x.src = p.src AND x.line < p.line)))"""
    else:
        dup = "false"
    fk = ""
    if "municipality_id" in scope:
        fk = ("WHEN NOT EXISTS (SELECT 1 FROM muni m WHERE m.season = p.season AND m.id = p.municipality_id) "
              "THEN 'no municipality'")
    return W(
        f"""
SELECT {cols}, status,
       CASE WHEN status = 'inserted'
            THEN coalesce(mx.m, 0) + row_number() OVER (PARTITION BY q.season, status = 'inserted' ORDER BY src, line)
       END AS new_id
FROM (
    SELECT p.*, CASE WHEN p.name = '' THEN 'blank' {fk} WHEN {dup} THEN 'duplicate' ELSE 'inserted' END AS status
    FROM p2 p
) q LEFT JOIN (SELECT season, max(id) AS m FROM {table} GROUP BY season) mx ON mx.season = q.season""",
        props,
        f"p2 AS (SELECT *, lower(trim(name)) AS key FROM (SELECT * REPLACE (coalesce({STRIP('name')}, '') AS name) FROM props))",
    )


def STEM(name: str) -> str:
    """A file name from a text: lower case, accents dropped, blanks as _, nothing else odd."""
    plain = f"regexp_replace(strip_accents(lower({name})), '\\s', '_', 'g')"
    return f"trim(regexp_replace({plain}, '[^a-z0-9_.-]', '', 'g'), '._')"


def CELL(x: str, number: bool) -> str:
    """A value as the CSV files hold it and as it is read back."""
    text = f"CASE WHEN {x} = floor({x}) THEN format('{{:.1f}}', {x}) ELSE CAST({x} AS VARCHAR) END" if number else f"CAST({x} AS VARCHAR)"
    return f"nullif({text}, '')"


def _template_sql() -> str:
    cols = ", ".join((f"f.{field}" if field else "''") + f" AS {name}" for name, field in TEMPLATE_COLUMNS.items())
    return W(
        f"""
SELECT f.season, f.association_id,
       row_number() OVER (PARTITION BY f.season, f.association_id
                          ORDER BY f.last_name NULLS FIRST, f.first_name NULLS FIRST, f.id) AS pos,
       f.last_name AS _last, f.first_name AS _first, f.id AS _id,
       {cols}
FROM farmer f"""
    )


def _short_sql() -> str:
    cols = ", ".join(f"f.{field} AS {name}" for name, field in SHORT_COLUMNS.items())
    slug = STEM("a.name")
    return W(
        f"""
SELECT f.season, f.association_id,
       coalesce({slug}, 'association') || '_' || f.season || '_farmers' AS file_stem,
       row_number() OVER (PARTITION BY f.season, f.association_id
                          ORDER BY f.last_name NULLS FIRST, f.first_name NULLS FIRST, f.id) AS pos,
       f.last_name AS _last, f.first_name AS _first, f.id AS _id,
       {cols}
FROM farmer f LEFT JOIN assoc a ON a.season = f.season AND a.id = f.association_id"""
    )


# One request after the other: each step of the recursion applies the next request of every
# municipality to the list of its associations.
ORDERED = (
    ASSOCIATION_REQUESTS_SQL
    + """,
numbered AS (
    SELECT CASE kind WHEN 'add' THEN -line ELSE k END AS who, kind, nation AS mun, trim(name) AS new_name, lower(trim(name)) AS key, line,
           row_number() OVER (PARTITION BY nation ORDER BY line) AS n
    FROM asked WHERE CASE kind WHEN 'add' THEN k % 50 <> 3 ELSE k % 11 <> 0 END
),
played AS (
    SELECT municipality_id AS mun, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS line, '' AS status, CAST(NULL AS VARCHAR) AS had,
           list({'who': id, 'key': lower(trim(name)), 'name': name}) AS held
    FROM assoc WHERE season = 'dry' GROUP BY municipality_id
    UNION ALL
    SELECT mun, n, line, status, had,
           CASE status
               WHEN 'deleted' THEN list_filter(held, lambda e: e.who <> w)
               WHEN 'inserted' THEN list_append(held, {'who': w, 'key': key, 'name': new_name})
               WHEN 'renamed' THEN list_transform(held, lambda e: CASE e.who WHEN w THEN {'who': w, 'key': key, 'name': new_name} ELSE e END)
               ELSE held END
    FROM (
        SELECT p.mun, o.n, o.line, o.who AS w, o.key, o.new_name, p.held, list_filter(p.held, lambda e: e.who = o.who)[1].name AS had,
               CASE WHEN o.kind <> 'add' AND len(list_filter(p.held, lambda e: e.who = o.who)) = 0 THEN 'not found'
                    WHEN o.kind = 'delete' THEN 'deleted'
                    WHEN len(list_filter(p.held, lambda e: e.key = o.key AND e.who <> o.who)) > 0 THEN 'duplicate'
                    WHEN o.kind = 'add' THEN 'inserted' ELSE 'renamed' END AS status
        FROM played p JOIN numbered o ON o.mun = p.mun AND o.n = p.n + 1
    )
),
ids AS (
    SELECT line, (SELECT max(id) FROM assoc WHERE season = 'dry') + row_number() OVER (ORDER BY line) AS new_id
    FROM played WHERE status = 'inserted'
),
after AS (
    SELECT coalesce(new_id, e.who) AS id, mun AS municipality_id, e.name AS name
    FROM (SELECT mun, unnest(arg_max(held, n)) AS e FROM played GROUP BY mun) LEFT JOIN ids ON line = -e.who
)"""
)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["season_summary"] = W("SELECT season, municipalities, associations, farmers, area, mt FROM summ", SEASON_TOT)
    q["season_dashboard"] = W(
        f"""SELECT season, municipalities, associations, farmers, {R2('area')} AS area, {R2('sacks')} AS sacks,
               {R2('kg')} AS kg, {R2(R2('kg') + ' / 1000.0::DOUBLE')} AS mt FROM tot""",
        SEASON_TOT,
    )
    q["season_averages"] = W(
        f"""SELECT season, {RATIO0('mt', 'municipalities')} AS avg_mt_per_municipality,
               {RATIO0('mt', 'associations')} AS avg_mt_per_association,
               {RATIO0('mt', 'area')} AS avg_yield, {RATIO0('mt', 'farmers')} AS avg_mt_per_farmer FROM summ""",
        SEASON_TOT,
    )
    q["season_change"] = W(
        f"""SELECT c.farmers - b.farmers AS farmer_difference, {R2('c.area - b.area')} AS area_difference,
               {R2('c.mt - b.mt')} AS production_difference,
               c.associations - b.associations AS association_difference,
               c.municipalities - b.municipalities AS municipality_difference,
               {PCT('b.farmers', 'c.farmers')} AS farmer_change, {PCT('b.area', 'c.area')} AS area_change,
               {PCT('b.mt', 'c.mt')} AS production_change,
               {TREND(R2('c.mt - b.mt'))} AS production_status, {TREND(R2('c.area - b.area'))} AS area_status,
               {TREND('c.farmers - b.farmers')} AS farmer_status
        FROM b, c""",
        SEASON_TOT,
    )
    q["overall_totals"] = W(
        f"""SELECT total_farmers, total_associations, total_area, total_mt, total_municipalities,
               {RATIO0('total_mt', 'total_area')} AS avg_yield,
               {RATIO0('total_mt', 'total_farmers')} AS avg_production_per_farmer,
               {RATIO0('total_area', 'total_farmers')} AS avg_area_per_farmer
        FROM (SELECT b.farmers + c.farmers AS total_farmers, b.associations + c.associations AS total_associations,
                     {R2('b.area + c.area')} AS total_area, {R2('b.mt + c.mt')} AS total_mt,
                     greatest(b.municipalities, c.municipalities) AS total_municipalities FROM b, c)""",
        SEASON_TOT,
    )
    q["municipality_rollup"] = W("SELECT season, id, name, associations, farmers, area, mt FROM mr", MUNI_ROLLUP)
    q["municipality_listing"] = W(
        """SELECT *, row_number() OVER (PARTITION BY season ORDER BY name, id) AS pos FROM (
             SELECT m.season, m.id, m.name, count(DISTINCT a.id) AS association_count, count(f.id) AS farmer_count
             FROM muni m LEFT JOIN assoc a ON a.season = m.season AND a.municipality_id = m.id
             LEFT JOIN farmer f ON f.season = a.season AND f.association_id = a.id
             GROUP BY m.season, m.id, m.name)"""
    )
    q["association_listing"] = W(
        """SELECT *, row_number() OVER (PARTITION BY season ORDER BY name, id) AS pos FROM (
             SELECT a.season, a.id, a.name, m.name AS municipality_name, count(f.id) AS farmer_count
             FROM assoc a LEFT JOIN muni m ON m.season = a.season AND m.id = a.municipality_id
             LEFT JOIN farmer f ON f.season = a.season AND f.association_id = a.id
             GROUP BY a.season, a.id, a.name, m.name)"""
    )
    q["association_listing_newest"] = W(
        """SELECT *, row_number() OVER (PARTITION BY season ORDER BY id DESC) AS pos FROM (
             SELECT a.season, a.id, a.name, m.name AS municipality_name, count(f.id) AS farmer_count
             FROM assoc a LEFT JOIN muni m ON m.season = a.season AND m.id = a.municipality_id
             LEFT JOIN farmer f ON f.season = a.season AND f.association_id = a.id
             GROUP BY a.season, a.id, a.name, m.name)"""
    )
    q["association_rollup"] = W(
        """SELECT *, row_number() OVER (PARTITION BY season, municipality_id ORDER BY name, id) AS pos FROM (
             SELECT a.season, a.municipality_id, a.id, a.name, count(f.id) AS farmer_count,
                    coalesce(sum(f.area), 0) AS total_area, coalesce(sum(f.sacks), 0) AS total_sacks,
                    coalesce(sum(f.sacks * f.kg), 0) AS total_kg
             FROM assoc a LEFT JOIN farmer f ON a.season = f.season AND a.id = f.association_id
             GROUP BY a.season, a.municipality_id, a.id, a.name)"""
    )
    q["municipality_totals"] = W(
        f"""SELECT ac.season, ac.id, ac.name, ac.association_count, coalesce(ft.c, 0) AS total_farmers,
               {R2('coalesce(ft.area, 0)')} AS total_area, {R2('coalesce(ft.sacks, 0)')} AS total_sacks,
               {R2('coalesce(ft.kg, 0)')} AS total_kg, {R2(R2('coalesce(ft.kg, 0)') + ' / 1000.0::DOUBLE')} AS total_mt
        FROM (SELECT m.season, m.id, m.name, count(a.id) AS association_count FROM muni m
              LEFT JOIN assoc a ON a.season = m.season AND a.municipality_id = m.id GROUP BY m.season, m.id, m.name) ac
        LEFT JOIN (SELECT a.season, a.municipality_id, count(f.id) AS c, sum(f.area) AS area, sum(f.sacks) AS sacks,
                          sum(f.sacks * f.kg) AS kg
                   FROM farmer f JOIN assoc a ON f.season = a.season AND f.association_id = a.id
                   GROUP BY a.season, a.municipality_id) ft
          ON ft.season = ac.season AND ft.municipality_id = ac.id"""
    )
    q["association_kpi"] = W(
        f"""SELECT season, id, name, total_farmers, total_area, total_sacks, total_kg, total_mt,
               CASE WHEN total_area > 0 THEN {R2('total_mt / total_area')} ELSE {Z} END AS average_yield
        FROM (SELECT *, {R2('total_kg / 1000.0::DOUBLE')} AS total_mt FROM (
              SELECT a.season, a.id, a.name, count(f.id) AS total_farmers,
                     {R2('coalesce(sum(f.area), 0)')} AS total_area, {R2('coalesce(sum(f.sacks), 0)')} AS total_sacks,
                     {R2('coalesce(sum(f.sacks * f.kg), 0)')} AS total_kg
              FROM assoc a LEFT JOIN farmer f ON f.season = a.season AND f.association_id = a.id
              GROUP BY a.season, a.id, a.name))"""
    )
    q["top_variety"] = W(
        f"""SELECT a.season, a.id AS association_id, a.name AS association, p.variety AS top_variety,
               coalesce(p.value, {Z}) AS top_value
        FROM assoc a LEFT JOIN (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY season, association_id ORDER BY value DESC, first_id) AS rn
                FROM (SELECT season, association_id,
                             CASE WHEN variety IS NULL OR variety = '' THEN 'Unknown' ELSE variety END AS variety,
                             sum(coalesce(sacks, 0) * coalesce(kg, 0)) AS value, min(id) AS first_id
                      FROM farmer GROUP BY ALL) WHERE value > 0) WHERE rn = 1
        ) p ON p.season = a.season AND p.association_id = a.id"""
    )
    q["variety_listing"] = W(
        """SELECT season, id, name, row_number() OVER (PARTITION BY season ORDER BY name, id) AS pos FROM (
             SELECT season, row_number() OVER (PARTITION BY season ORDER BY name) AS id, name
             FROM (SELECT DISTINCT season, variety AS name FROM farmer WHERE variety <> ''))"""
    )
    q["municipality_comparison"] = W("SELECT * FROM cmp", MUNI_CMP)
    q["municipality_yield"] = W(
        f"""SELECT pos, municipality,
               CASE WHEN base_area > 0 THEN {R2('base_mt / base_area')} ELSE {Z} END AS base_yield,
               CASE WHEN current_area > 0 THEN {R2('current_mt / current_area')} ELSE {Z} END AS current_yield,
               change,
               CASE WHEN change IS NULL THEN 'N/A'
                    WHEN change > 0 THEN '▲ ' || format('{{:.2f}}', change) || '%'
                    WHEN change < 0 THEN '▼ ' || format('{{:.2f}}', change) || '%'
                    ELSE '▬ 0%' END AS change_marker
        FROM cmp""",
        MUNI_CMP,
    )
    long_parts = []
    for side, season in (("base", "wet"), ("current", "dry")):
        m, a = f"{side}_mt", f"{side}_area"
        for metric, value in (
            ("production", m),
            ("yield", f"CASE WHEN {a} > 0 THEN {m} / {a} ELSE {Z} END"),
            ("area", a),
        ):
            long_parts.append(
                f"SELECT '{metric}' AS metric, '{season}' AS season, pos, municipality, "
                f"CAST({value} AS DOUBLE) AS value, {m} AS mt, {a} AS area FROM cmp"
            )
    q["top_performers"] = W(
        f"""SELECT s.metric, s.season, coalesce(p.municipality, '-') AS municipality,
               coalesce(p.value, {Z}) AS value, coalesce(p.mt, {Z}) AS mt, coalesce(p.area, {Z}) AS area,
               s.season = 'dry' AS headline
        FROM (VALUES ('production', 'wet'), ('production', 'dry'), ('yield', 'wet'), ('yield', 'dry'),
                     ('area', 'wet'), ('area', 'dry')) s(metric, season)
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, season ORDER BY value DESC, pos) AS rn
                                  FROM ({' UNION ALL '.join(long_parts)})) WHERE rn = 1) p
          ON p.metric = s.metric AND p.season = s.season""",
        MUNI_CMP,
    )
    q["association_comparison"] = W(
        f"""SELECT coalesce(x.town, y.town) AS municipality, x.coop AS base_association, y.coop AS current_association,
               coalesce(x.n, 0) AS base_farmers, coalesce(y.n, 0) AS current_farmers,
               {R2('coalesce(x.area, 0)')} AS base_area, {R2('coalesce(y.area, 0)')} AS current_area,
               {RATIO0('coalesce(x.mt, 0)', 'coalesce(x.area, 0)')} AS base_yield,
               {RATIO0('coalesce(y.mt, 0)', 'coalesce(y.area, 0)')} AS current_yield,
               x.association_id AS base_id, y.association_id AS current_id,
               row_number() OVER (ORDER BY coalesce(x.town, y.town), x.coop NULLS FIRST, y.coop NULLS FIRST,
                                  x.association_id NULLS FIRST, y.association_id NULLS FIRST) AS pos
        FROM (FROM place WHERE season = 'wet') x FULL OUTER JOIN (FROM place WHERE season = 'dry') y ON x.pair = y.pair""",
        PLACES,
    )
    t = C.FARMER_SEARCH_TERM
    q["farmer_search"] = W(
        f"""SELECT {FARMER_COLS_F}, a.name AS association, m.name AS municipality,
               CASE f.season WHEN 'wet' THEN '{C.SEARCH_LABELS['wet']}' WHEN 'dry' THEN '{C.SEARCH_LABELS['dry']}' END
                   AS season_label
        FROM farmer f JOIN assoc a ON a.season = f.season AND a.id = f.association_id
        JOIN muni m ON m.season = a.season AND m.id = a.municipality_id
        WHERE {LIKE('f.rsbsa', t)} OR {LIKE('f.last_name', t)} OR {LIKE('f.first_name', t)}"""
    )
    terms = " UNION ALL ".join(f"SELECT *, '{x}' AS term FROM found WHERE {LIKE('rsbsa', x)} OR {LIKE('last_name', x)} OR {LIKE('first_name', x)}" for x in (C.FARMER_SEARCH_TERM, C.INDEXED_SEARCH_TERM))
    q["farmer_search_indexed"] = W(
        terms,
        f"""found AS (SELECT {FARMER_COLS_F}, a.name AS association, m.name AS municipality,
               CASE f.season WHEN 'wet' THEN '{C.SEARCH_LABELS['wet']}' ELSE '{C.SEARCH_LABELS['dry']}' END AS season_label
            FROM farmer f JOIN assoc a ON a.season = f.season AND a.id = f.association_id
            JOIN muni m ON m.season = a.season AND m.id = a.municipality_id)""",
    )
    t = C.ASSOCIATION_SEARCH_TERM
    q["association_farmer_search"] = W(
        f"""SELECT {FARMER_COLS_F},
               coalesce(f.sacks, 0) * coalesce(f.kg, 0) AS total_kg,
               coalesce(f.sacks, 0) * coalesce(f.kg, 0) / 1000.0::DOUBLE AS total_mt,
               coalesce(nullif(f.rsbsa, ''), '-') AS rsbsa_display,
               coalesce(nullif(f.middle_name, ''), '-') AS middle_name_display,
               row_number() OVER (PARTITION BY f.season, f.association_id
                                  ORDER BY f.last_name NULLS FIRST, f.first_name NULLS FIRST, f.id) AS pos
        FROM farmer f
        WHERE ({LIKE('f.rsbsa', t)} OR {LIKE('f.last_name', t)} OR {LIKE('f.first_name', t)})
          AND EXISTS (SELECT 1 FROM assoc a WHERE a.season = f.season AND a.id = f.association_id)"""
    )
    q["farmer_top100"] = W(
        f"""SELECT {FARMER_COLS_F}, a.name AS association_name, m.name AS municipality_name, f.pos
        FROM (SELECT *, row_number() OVER (PARTITION BY season
                                            ORDER BY last_name NULLS FIRST, first_name NULLS FIRST, id) AS pos
              FROM farmer) f
        LEFT JOIN assoc a ON a.season = f.season AND a.id = f.association_id
        LEFT JOIN muni m ON m.season = a.season AND m.id = a.municipality_id
        WHERE f.pos <= {100}"""
    )
    lo = (C.REPORT_PAGE - 1) * 15
    q["report_stats"] = W("SELECT * FROM stats", REPORT_ROWS)
    q["report_page"] = W(
        f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY farmer_name NULLS FIRST, season, id) AS pos
                          FROM filtered) WHERE pos > {lo} AND pos <= {lo + 15}""",
        REPORT_ROWS,
    )
    q["report_pages_ranked"] = W(
        """SELECT *, (pos - 1) // 15 + 1 AS page
           FROM (SELECT *, row_number() OVER (ORDER BY farmer_name NULLS FIRST, season, id) AS pos FROM filtered)
           WHERE (pos - 1) // 15 IN (0, 2, (SELECT (count(*) - 1) // 15 FROM filtered))""",
        REPORT_ROWS,
    )
    q["report_page_info"] = W(
        f"""SELECT CAST({C.REPORT_PAGE} AS BIGINT) AS page, CAST(15 AS BIGINT) AS per_page, total_pages,
               total_records, {C.REPORT_PAGE} < total_pages AS has_next, {C.REPORT_PAGE} > 1 AS has_prev
        FROM (SELECT total_records,
                     CASE WHEN total_records > 0 THEN CAST(ceil(total_records / 15) AS BIGINT)
                          ELSE CAST(1 AS BIGINT) END AS total_pages FROM stats)""",
        REPORT_ROWS,
    )
    q["municipality_names"] = W(
        """SELECT name, row_number() OVER (ORDER BY name) AS pos FROM (
             SELECT DISTINCT name FROM muni WHERE name IS NOT NULL AND name <> '')"""
    )
    q["upload_classified"] = W("SELECT * FROM classified", UPLOAD_SQL, UPLOAD_CLEAN)
    q["upload_summary"] = W(
        """SELECT season, CAST(sum(CASE WHEN status = 'inserted' THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
                  CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS duplicates,
                  CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped
           FROM classified GROUP BY season""",
        UPLOAD_SQL,
        UPLOAD_CLEAN,
    )
    after = f"after_ AS (SELECT {FARMER_COLS} FROM existing UNION ALL SELECT {FARMER_COLS} FROM classified WHERE status = 'inserted')"
    q["upload_apply"] = W(_rows({"farmer": "after_"}), UPLOAD_SQL, UPLOAD_CLEAN, after)
    q["upload_csv"] = q["upload_classified"]
    # which of two equal keys comes first depends on the files, but one of them is inserted,
    # and the new ids run on without a gap
    q["upload_commit"] = W(
        "SELECT season, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids, min(id) AS first, max(id) AS last FROM after_ GROUP BY season",
        UPLOAD_SQL,
        UPLOAD_CLEAN,
        after,
    )
    q["upload_short"] = W(
        """SELECT season, association_id, line, rsbsa, last_name, first_name, middle_name, suffix, area,
                  CASE WHEN claimed_text IN ('', 'nan', 'n/a') THEN '' ELSE claimed_text END AS variety, sacks, kg, skipped
           FROM k JOIN (SELECT season, line, claimed_text FROM upload_src) u USING (season, line)""",
        UPLOAD_SQL,
        UPLOAD_CLEAN,
    )
    q["insert_farmers"] = W(
        """SELECT season, association_id, line, rsbsa, last_name, first_name, middle_name, suffix, variety,
                  area, sacks, kg, status,
                  CASE WHEN status = 'inserted'
                       THEN coalesce(mx.m, 0) + row_number() OVER (PARTITION BY t.season, status = 'inserted' ORDER BY line)
                  END AS id
           FROM (SELECT *, CASE WHEN NOT valid THEN 'invalid'
                                WHEN NOT EXISTS (SELECT 1 FROM assoc a WHERE a.season = typed.season
                                                 AND a.id = typed.association_id) THEN 'no association'
                                ELSE 'inserted' END AS status
                 FROM typed) t
           LEFT JOIN (SELECT season AS s, max(id) AS m FROM existing GROUP BY season) mx ON mx.s = t.season""",
        FORM_INSERTS,
        f"typed AS ({_typed('fi', 'season, association_id, line')})",
    )
    q["insert_farmers_table"] = W(
        f"""SELECT {FARMER_COLS} FROM existing
           UNION ALL
           SELECT season, coalesce(m, 0) + row_number() OVER (PARTITION BY season ORDER BY line), association_id, rsbsa, last_name,
                  first_name, middle_name, suffix, area, variety, sacks, kg
           FROM typed SEMI JOIN assoc a ON a.season = typed.season AND a.id = typed.association_id
           LEFT JOIN (SELECT season AS s, max(id) AS m FROM existing GROUP BY season) mx ON mx.s = typed.season
           WHERE valid""",
        FORM_INSERTS,
        f"typed AS ({_typed('fi', 'season, association_id, line')})",
    )
    edited = ["rsbsa", "last_name", "first_name", "middle_name", "suffix", "area", "variety", "sacks", "kg"]
    q["update_farmers"] = W(
        f"""SELECT season, id, association_id, {', '.join('w.' + c for c in edited)} FROM farmer f JOIN winner w USING (season, id)
        UNION ALL
        SELECT season, id, association_id, {', '.join(edited)} FROM farmer f ANTI JOIN winner w USING (season, id)""",
        EDITS,
    )
    q["update_farmers_committed"] = W(
        f"""SELECT season, id, association_id, {', '.join('w.' + c for c in edited)} FROM farmer f JOIN winner w USING (season, id)
        WHERE season = 'dry'
        UNION ALL
        SELECT season, id, association_id, {', '.join(edited)} FROM farmer f
        WHERE season = 'wet' OR id NOT IN (SELECT id FROM winner WHERE season = 'dry')""",
        EDITS,
    )
    q["totals_after_changes"] = W(
        f"""SELECT season, id, name, total_farmers, total_area, total_sacks, total_kg, total_mt,
               CASE WHEN total_area > 0 THEN {R2('total_mt / total_area')} ELSE {Z} END AS average_yield
        FROM (SELECT *, {R2('total_kg / 1000.0::DOUBLE')} AS total_mt FROM (
              SELECT a.season, a.id, a.name, count(f.id) AS total_farmers,
                     {R2('coalesce(sum(f.area), 0)')} AS total_area, {R2('coalesce(sum(f.sacks), 0)')} AS total_sacks,
                     {R2('coalesce(sum(f.sacks * f.kg), 0)')} AS total_kg
              FROM assoc a LEFT JOIN now_ f ON f.season = a.season AND f.association_id = a.id
              WHERE NOT (a.season = 'wet' AND a.id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'))
              GROUP BY a.season, a.id, a.name))""",
        EDITS,
        f"""now_ AS (
            SELECT season, id, association_id, area, sacks, kg FROM (
                SELECT season, id, association_id, {', '.join('w.' + c for c in edited)} FROM farmer f JOIN winner w USING (season, id)
                UNION ALL
                SELECT season, id, association_id, {', '.join(edited)} FROM farmer f ANTI JOIN winner w USING (season, id))
            WHERE id NOT IN (SELECT d.id FROM farmer_src d WHERE d.o_orderstatus = 'F' AND d.o_orderpriority = '2-HIGH'))""",
    )
    q["update_farmer_outcomes"] = W(
        """SELECT t.season, t.id, t.line, t.rsbsa, t.last_name, t.first_name, t.middle_name, t.suffix, t.variety,
                  t.area, t.sacks, t.kg,
                  CASE WHEN f.id IS NULL THEN 'not found' WHEN NOT t.valid THEN 'invalid'
                       WHEN w.line = t.line THEN 'updated' ELSE 'superseded' END AS status
           FROM typed t LEFT JOIN farmer f ON f.season = t.season AND f.id = t.id
           LEFT JOIN winner w ON w.season = t.season AND w.id = t.id""",
        EDITS,
    )
    q["delete_farmers"] = W(
        _rows({"farmer": "kept"}),
        """kept AS (SELECT * FROM farmer_src f WHERE NOT EXISTS (
               SELECT 1 FROM farmer_src d WHERE d.o_orderstatus = 'F' AND d.o_orderpriority = '2-HIGH'
               AND d.season = f.season AND d.id = f.id))""",
    )
    q["delete_association_cascade"] = W(
        _rows({"municipality": "muni", "association": "a_kept", "farmer": "f_kept"}),
        """dels AS (SELECT 'wet' AS season, CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_mktsegment = 'AUTOMOBILE'),
        a_kept AS (SELECT * FROM assoc a WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.season = a.season AND d.id = a.id)),
        f_kept AS (SELECT * FROM farmer f WHERE NOT EXISTS (
            SELECT 1 FROM dels d WHERE d.season = f.season AND d.id = f.association_id))""",
    )
    q["delete_municipality_cascade"] = W(
        _rows({"municipality": "m_kept", "association": "a_kept", "farmer": "f_kept"}),
        """dels AS (SELECT s.season, CAST(n_nationkey AS BIGINT) AS id FROM nation, (VALUES ('wet'), ('dry')) s(season)
                    WHERE n_regionkey = 2),
        m_kept AS (SELECT * FROM muni m WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.season = m.season AND d.id = m.id)),
        victims AS (SELECT a.season, a.id FROM assoc a WHERE a.municipality_id IN (
            SELECT d.id FROM dels d WHERE d.season = a.season)),
        a_kept AS (SELECT * FROM assoc a WHERE NOT EXISTS (SELECT 1 FROM victims v WHERE v.season = a.season AND v.id = a.id)),
        f_kept AS (SELECT * FROM farmer f WHERE NOT EXISTS (
            SELECT 1 FROM victims v WHERE v.season = f.season AND v.id = f.association_id))""",
    )
    acols = "q.season, q.municipality_id, q.name, q.src, q.line"
    q["add_associations_unique"] = _add_sql(ASSOC_PROPOSALS, "assoc", ["season", "municipality_id"], True, acols)
    q["add_associations_table"] = f"""WITH outcome AS ({q['add_associations_unique']}), {MODEL_SQL}
        SELECT season, id, municipality_id, name FROM assoc
        UNION ALL SELECT season, new_id, municipality_id, name FROM outcome WHERE status = 'inserted'"""
    q["add_associations"] = _add_sql(ASSOC_PROPOSALS, "assoc", ["season", "municipality_id"], False, acols)
    q["add_municipalities_unique"] = _add_sql(MUNI_PROPOSALS, "muni", ["season"], True, "q.season, q.name, q.src, q.line")
    q["add_municipalities"] = _add_sql(MUNI_PROPOSALS, "muni", ["season"], False, "q.season, q.name, q.src, q.line")
    q["rename_associations_unique"] = W(
        """SELECT season, id, line, old_name, new_name,
                  CASE WHEN old_name IS NULL THEN 'not found' WHEN new_name = '' THEN 'blank'
                       WHEN taken THEN 'duplicate'
                       WHEN EXISTS (SELECT 1 FROM cand c2 WHERE c2.season = r.season AND c2.municipality_id = r.municipality_id
                                    AND c2.key = r.key AND NOT c2.taken AND c2.line < r.line) THEN 'duplicate'
                       ELSE 'renamed' END AS status
           FROM cand r""",
        """ren AS (
            SELECT 'dry' AS season, CAST(c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1000000000 ELSE 0 END AS BIGINT) AS id,
                   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Assoc ' || CAST(c_nationkey AS VARCHAR)
                        WHEN c_mktsegment = 'AUTOMOBILE' THEN lower(c_name) ELSE ' ' END AS name,
                   CAST(c_custkey AS BIGINT) AS line
            FROM customer
            WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') OR (c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0)
        ),
        r0 AS (SELECT r.season, r.id, r.line, coalesce("""
        + STRIP("r.name")
        + """, '') AS new_name, a.name AS old_name, a.municipality_id
               FROM ren r LEFT JOIN assoc a ON a.season = r.season AND a.id = r.id),
        cand AS (SELECT r0.*, lower(trim(new_name)) AS key,
                        EXISTS (SELECT 1 FROM assoc x WHERE x.season = r0.season AND x.municipality_id = r0.municipality_id
                                AND lower(trim(x.name)) = lower(trim(r0.new_name)) AND x.id <> r0.id) AS taken
                 FROM r0)""",
    )
    unique_renames = q["rename_associations_unique"]
    q["rename_associations_table"] = f"""WITH outcome AS ({unique_renames}),
        renamed AS (SELECT season, id, arg_max(new_name, line) AS name FROM outcome WHERE status = 'renamed' GROUP BY season, id),
        {MODEL_SQL}
        SELECT a.season, a.id, a.municipality_id, coalesce(r.name, a.name) AS name
        FROM assoc a LEFT JOIN renamed r ON r.season = a.season AND r.id = a.id"""
    q["rename_associations"] = W(
        """SELECT season, id, line, old_name, new_name,
                  CASE WHEN old_name IS NULL THEN 'not found' WHEN new_name = '' THEN 'blank'
                       ELSE 'renamed' END AS status
           FROM cand r""",
        """ren AS (
            SELECT 'dry' AS season, CAST(c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1000000000 ELSE 0 END AS BIGINT) AS id,
                   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Assoc ' || CAST(c_nationkey AS VARCHAR)
                        WHEN c_mktsegment = 'AUTOMOBILE' THEN lower(c_name) ELSE ' ' END AS name,
                   CAST(c_custkey AS BIGINT) AS line
            FROM customer
            WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') OR (c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0)
        ),
        r0 AS (SELECT r.season, r.id, r.line, coalesce("""
        + STRIP("r.name")
        + """, '') AS new_name, a.name AS old_name, a.municipality_id
               FROM ren r LEFT JOIN assoc a ON a.season = r.season AND a.id = r.id),
        cand AS (SELECT r0.*, lower(trim(new_name)) AS key,
                        EXISTS (SELECT 1 FROM assoc x WHERE x.season = r0.season AND x.municipality_id = r0.municipality_id
                                AND lower(trim(x.name)) = lower(trim(r0.new_name)) AND x.id <> r0.id) AS taken
                 FROM r0)""",
    )
    q["rename_associations_ordered"] = f"""WITH RECURSIVE {MODEL_SQL}, {ORDERED}
        SELECT o.kind, 'dry' AS season,
               CASE WHEN o.kind <> 'add' THEN o.k + CASE WHEN o.k % 11 = 0 THEN 1000000000 ELSE 0 END END AS id, o.line,
               coalesce(p.had, CASE WHEN o.kind <> 'add' AND o.k % 11 <> 0 THEN c.dry END) AS old_name, trim(o.name) AS new_name,
               coalesce(p.status, CASE o.kind WHEN 'add' THEN 'no municipality' ELSE 'not found' END) AS status, i.new_id
        FROM asked o JOIN cust c ON c.k = o.k LEFT JOIN played p ON p.line = o.line LEFT JOIN ids i ON i.line = o.line"""
    q["rename_associations_ordered_table"] = f"""WITH RECURSIVE {MODEL_SQL}, {ORDERED}
        SELECT 'association' AS table_name, season, id, municipality_id AS parent_id, name,
               CAST(NULL AS DOUBLE) AS area, CAST(NULL AS DOUBLE) AS sacks, CAST(NULL AS DOUBLE) AS kg
        FROM (SELECT 'dry' AS season, id, municipality_id, name FROM after
              UNION ALL SELECT season, id, municipality_id, name FROM assoc WHERE season = 'wet')
        UNION ALL
        SELECT 'farmer', season, id, association_id, concat_ws('|', rsbsa, last_name, first_name, middle_name, suffix, variety), area, sacks, kg
        FROM farmer f WHERE season = 'wet' OR EXISTS (SELECT 1 FROM after a WHERE a.id = f.association_id)"""
    q["rename_municipalities"] = W(
        """SELECT r.season, r.id, r.line, m.name AS old_name, r.new_name,
                  CASE WHEN m.name IS NULL THEN 'not found' WHEN r.new_name = '' THEN 'blank' ELSE 'renamed' END AS status
           FROM (SELECT season, id, line, coalesce("""
        + STRIP("name")
        + """, '') AS new_name FROM ren) r
           LEFT JOIN muni m ON m.season = r.season AND m.id = r.id""",
        """ren AS (SELECT 'wet' AS season, CAST(n_nationkey AS BIGINT) AS id,
                   CASE WHEN n_regionkey = 1 THEN n_name || ' (renamed)' ELSE ' ' END AS name,
                   CAST(n_nationkey AS BIGINT) AS line
            FROM nation WHERE n_regionkey IN (0, 1))""",
    )
    seeds = ", ".join(f"({i}, '{n}')" for i, n in enumerate(SEED_VARIETIES))
    q["snapshot_names"] = "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y%m%d_%H%M%S') AS snapshot FROM orders"
    q["seed_varieties"] = W(
        """SELECT season, id, name FROM variety
           UNION ALL
           SELECT s.season, coalesce(mx.m, 0) + row_number() OVER (PARTITION BY s.season ORDER BY s.seed_order) AS id, s.name
           FROM (SELECT ss.season, sd.seed_order, sd.name FROM seeds sd, (VALUES ('wet'), ('dry')) ss(season)) s
           LEFT JOIN (SELECT season, max(id) AS m FROM variety GROUP BY season) mx ON mx.season = s.season
           WHERE NOT EXISTS (SELECT 1 FROM variety v WHERE v.season = s.season AND v.name = s.name)""",
        """variety AS (SELECT season, row_number() OVER (PARTITION BY season ORDER BY name) AS id, name
                       FROM (SELECT DISTINCT season, variety AS name FROM farmer WHERE variety <> ''))""",
        f"seeds(seed_order, name) AS (VALUES {seeds})",
    )
    varieties = """variety AS (SELECT season, row_number() OVER (PARTITION BY season ORDER BY name) AS id, name
                       FROM (SELECT DISTINCT season, variety AS name FROM farmer WHERE variety <> ''))"""
    every = {"municipality": "muni", "association": "assoc", "variety": "variety", "farmer": "farmer"}
    for name in ("snapshot_restore", "snapshot_pinned", "import_replace", "table_copy"):
        q[name] = W(_rows(every), varieties)
    q["snapshot_list"] = W(
        "\nUNION ALL\n".join(
            f"SELECT '{ts}' AS ts, '{name}' AS table_name, count(*) AS rows FROM {rel}"
            for ts in ("20260101_080000", "20260201_080000") for name, rel in every.items()
        ),
        varieties,
    )
    numbers = ("area", "sacks", "kg")
    cells = ", ".join(f"{CELL('f.' + f, f in numbers) if f else 'CAST(NULL AS VARCHAR)'} AS {n}" for n, f in TEMPLATE_COLUMNS.items())
    q["template_export_files"] = W(f"SELECT season, association_id, {cells} FROM farmer f")
    cells = ", ".join(f"{CELL('f.' + f, f in numbers)} AS {n}" for n, f in SHORT_COLUMNS.items())
    q["short_export_files"] = W(
        f"""SELECT f.season, association_id, coalesce({STEM("CASE WHEN a.id % 4 = 0 THEN 'Rice One' ELSE a.name END")}, 'association')
                  || '_' || f.season || '_farmers' AS file_stem, {cells}
        FROM farmer f LEFT JOIN assoc a ON a.season = f.season AND a.id = f.association_id"""
    )
    season, i = C.ONE_ASSOCIATION
    q["association_farmers_one"] = W(
        f"""SELECT {FARMER_COLS_F}, coalesce(f.sacks, 0) * coalesce(f.kg, 0) AS total_kg,
               coalesce(f.sacks, 0) * coalesce(f.kg, 0) / 1000.0::DOUBLE AS total_mt,
               coalesce(nullif(f.rsbsa, ''), '-') AS rsbsa_display, coalesce(nullif(f.middle_name, ''), '-') AS middle_name_display,
               row_number() OVER (ORDER BY f.last_name NULLS FIRST, f.first_name NULLS FIRST, f.id) AS pos
        FROM farmer f WHERE f.season = '{season}' AND f.association_id = {i}"""
    )
    season, i = C.ONE_MUNICIPALITY
    q["municipality_associations_one"] = W(
        f"""SELECT a.season, a.municipality_id, a.id, a.name, coalesce(n, 0) AS farmer_count, coalesce(m.area, 0) AS total_area,
               coalesce(m.sacks, 0) AS total_sacks, coalesce(m.kg, 0) AS total_kg, row_number() OVER (ORDER BY a.name, a.id) AS pos
        FROM assoc a LEFT JOIN (SELECT season, association_id, count(*) AS n, sum(area) AS area, sum(sacks) AS sacks,
                                       sum(sacks * kg) AS kg FROM farmer GROUP BY ALL) m
          ON m.season = a.season AND m.association_id = a.id
        WHERE a.season = '{season}' AND a.municipality_id = {i}"""
    )
    season, i = C.ONE_FARMER
    q["farmer_by_id"] = W(f"SELECT {FARMER_COLS} FROM farmer WHERE season = '{season}' AND id = {i}")
    q["association_sample"] = W("SELECT season, id, municipality_id, name FROM assoc ORDER BY season, id LIMIT 5")
    q["report_stats_wet"] = W(
        f"""SELECT count(*) AS total_records, {R2('coalesce(sum(area_hectares), 0)')} AS total_area,
               {R2('coalesce(sum(estimated_yield_tons), 0)')} AS total_yield
        FROM rows_ WHERE season = 'Wet' AND ({LIKE('farmer_name', C.REPORT_SEARCH)} OR {LIKE('association', C.REPORT_SEARCH)})""",
        REPORT_ROWS,
    )
    q["template_export"] = _template_sql()
    q["short_export"] = _short_sql()
    return q
