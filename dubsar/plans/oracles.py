"""DuckDB SQL for the queries: what each should return, from the relational columns alone."""

from __future__ import annotations

from dubsar.functions import lexicon as L
from dubsar.sources.synthetic import _ITEM_TEXT, EXPECTED, ORACLE_BASE, SPECIES


def base(select: str) -> str:
    return f"WITH {ORACLE_BASE} {select}"


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


_BRANCH = _values({n: b for n, (_, b) in L.OFFICE_OF.items()})
_SPECIES_CATEGORY = "CASE WHEN key IN ('udu', 'u8') THEN 'sheep_adult' WHEN key = 'sila4' THEN 'sheep_young' WHEN key = 'masz2' THEN 'goat_adult' WHEN key IN ('gu4', 'ab2') THEN 'cattle_adult' ELSE 'other' END"
_DEITY_CATEGORY = "CASE key WHEN '{d}inanna' THEN 'uruk' WHEN '{d}en-lil2' THEN 'nippur' WHEN '{d}nanna' THEN 'ur' ELSE 'other' END"
_PLACE_CATEGORY = "CASE key WHEN 'e2-muhaldim-sze3' THEN 'kitchen' WHEN 'sza3 nibru{ki}' THEN 'city' ELSE 'palace' END"
_EXTERNAL = "tx IN ('delivery', 'royal_delivery', 'expenditure')"
_DESTINATION = "CASE WHEN blank THEN '' ELSE CASE o_orderpriority WHEN '3-MEDIUM' THEN 'e2-muhaldim-sze3' WHEN '4-NOT SPECIFIED' THEN 'sza3 nibru{ki}' WHEN '5-LOW' THEN 'e2-gal-la ba-an-kux' ELSE '' END END"
_KIND = "CASE WHEN blank THEN '' ELSE CASE o_orderpriority WHEN '3-MEDIUM' THEN 'kitchen' WHEN '4-NOT SPECIFIED' THEN 'city' WHEN '5-LOW' THEN 'palace' ELSE '' END END"
_PERSONS = """persons_ AS (
  SELECT tablet_id, o_orderkey, 1 AS seq, 'source' AS role, source AS name, '' AS title FROM done_ WHERE NOT blank
  UNION ALL SELECT tablet_id, o_orderkey, 2, 'receiver', receiver, '' FROM done_ WHERE has_receiver
  UNION ALL SELECT tablet_id, o_orderkey, 2, 'deliverer', deliverer, '' FROM done_ WHERE NOT blank AND urgent AND NOT royal
  UNION ALL SELECT tablet_id, o_orderkey, 3, 'intermediary', receiver, 'dub-sar' FROM done_ WHERE NOT blank AND with_giri
  UNION ALL SELECT tablet_id, o_orderkey, 4, 'commissioner', deliverer, 'sukkal' FROM done_ WHERE NOT blank AND with_maszkim
  UNION ALL SELECT tablet_id, o_orderkey, 5, 'sealer', receiver, '' FROM done_ WHERE NOT blank AND with_kiszib
)"""
_OFFICIALS = f"""{_PERSONS}, branch_(name, branch) AS (VALUES {_BRANCH}), mention_ AS (
  SELECT p.tablet_id, p.role, d.period, (d.r_idx * 100 + d.reign_)::BIGINT AS ord, b.branch,
         CASE WHEN p.name = 'in-ta-e3-a' THEN CASE WHEN d.r_idx < 1 OR (d.r_idx = 1 AND (d.reign_ < 9 OR (d.reign_ = 9 AND d.month_ <= 7))) THEN 'in-ta-e3-a#S' ELSE 'in-ta-e3-a#C' END ELSE p.name END AS official
  FROM persons_ p JOIN done_ d USING (o_orderkey) JOIN branch_ b ON b.name = p.name WHERE d.r_idx >= 0 AND p.role IN ('source', 'receiver', 'intermediary')
)"""
_OFFICE = "CASE WHEN official LIKE '%#S' THEN 'S' WHEN official LIKE '%#C' THEN 'C' WHEN branch LIKE 'Chief%' THEN 'C' WHEN branch LIKE 'Disb%' THEN 'D' WHEN branch LIKE 'Shep%' THEN 'S' ELSE 'X' END"


def _timeline(source: str, category: str, least: int) -> str:
    return f"""
, c_ AS ({source}), totals_ AS (SELECT key, sum(n)::BIGINT AS total_count, count(*) AS tablets, max(n) AS max_count FROM c_ GROUP BY key HAVING count(*) >= {least}), all_ AS (
  SELECT key, 'total' AS granularity, '' AS period, total_count, tablets, max_count FROM totals_
  UNION ALL SELECT key, 'year', period_y, sum(n)::BIGINT, count(*), max(n) FROM c_ WHERE key IN (SELECT key FROM totals_) GROUP BY key, period_y
  UNION ALL SELECT key, 'month', period_m, sum(n)::BIGINT, count(*), max(n) FROM c_ WHERE key IN (SELECT key FROM totals_) GROUP BY key, period_m
) SELECT *, {category} AS category FROM all_"""


_SIDES = f"""{_PERSONS}, branch_(name, branch) AS (VALUES {_BRANCH}), side_ AS (
  SELECT o_orderkey, CASE WHEN role IN ('source', 'deliverer') THEN 's' ELSE 'r' END AS side, branch, min(seq) AS seq FROM persons_ JOIN branch_ USING (name) WHERE role IN ('source', 'deliverer', 'receiver', 'sealer') GROUP BY 1, 2, 3
)"""


def _side(which: str) -> str:
    return f"coalesce((SELECT string_agg(branch, '; ' ORDER BY seq) FROM side_ s WHERE s.o_orderkey = d.o_orderkey AND side = '{which}'), '')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(of: str, table: dict[str, str], default: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _if(condition: str, value: str) -> str:
    """value on tablets with a text that meet the condition, else ''."""
    return f"CASE WHEN NOT blank AND {condition} THEN {value} ELSE '' END"


#: Entries of a tablet in the order of their lines, then the total; those of lost numerals are found last.
_IN_ORDER = "ORDER BY kind = 'lost', l_linenumber < 0, l_linenumber, l_partkey, l_suppkey, given"
_QUALIFIERS = "list_filter([CASE WHEN dead THEN 'ba-usz2' END, nullif(qualifier, '')], lambda x: x IS NOT NULL)"
_DATE = "CASE WHEN undated THEN '00.00.00.00' ELSE ruler || '.' || lpad(reign::STRING, 2, '0') || '.' || lpad(m::STRING, 2, '0') || '.' || lpad(d::STRING, 2, '0') END"


def _sentences() -> str:
    """en and nl of every tablet."""
    office = {n: f" [{b}]" for n, (_, b) in L.OFFICE_OF.items()}
    who = {"source": ("source", "true", ""), "deliverer": ("deliverer", "urgent AND NOT royal", ""), "receiver": ("receiver", "has_receiver", ""), "intermediary": ("receiver", "with_giri", " (dub-sar)")}
    words = {
        "en": ("This tablet ", "records a ", " involving", " and ", " more entries", "animals (details unclear)", ("From ", "Delivered by ", "Received by ", "Via "), "For ", "Destination: ", "Dated month ", ", day "),
        "nl": ("Dit tablet ", "beschrijft een ", " van", " en ", " meer", "dieren (details onduidelijk)", ("Van ", "Geleverd door ", "Ontvangen door ", "Via "), "Voor ", "Bestemming: ", "Gedateerd maand ", ", dag "),
    }
    told, said = [], []
    for k, (language, (this, records, of, also, more, unclear, leads, god, place, month, day)) in enumerate(words.items()):
        name = _case("species", {t: L.GLOSS[t][k] for t in SPECIES.values()}, "species")
        told.append(f"list(n::STRING || ' ' || {name} || CASE WHEN len({_QUALIFIERS}) > 0 THEN ' (' || array_to_string({_QUALIFIERS}, ', ') || ')' ELSE '' END {_IN_ORDER}) AS told_{language}")
        verb = _case("tx_", {t: v[k] for t, v in L.VERBS.items()}, f"'{records}' || tx_ || '{of}'")
        beasts = f"CASE WHEN n_told IS NULL THEN '{unclear}' ELSE array_to_string(told_{language}[1:5], ', ') || CASE WHEN n_told > 5 THEN '{also}' || (n_told - 5)::STRING || '{more}' ELSE '' END END"
        people = [f"CASE WHEN NOT blank AND {when} THEN '{lead}' || {column} || '{title}' || {_case(column, office, repr(''))} || '.' END" for lead, (column, when, title) in zip(leads, who.values(), strict=True)]
        said.append(
            f"concat_ws(' ', '{this}' || {verb} || ' ' || {beasts} || '.', {', '.join(people)}, CASE WHEN NOT blank AND deity <> '' THEN '{god}god ' || replace(deity, '{{d}}', '') || '.' END, "
            f"CASE WHEN {_DESTINATION} <> '' THEN '{place}' || {_DESTINATION} || '.' END, CASE WHEN NOT blank THEN '{month}' || month_name || '{day}' || d || '.' END) AS {language}"
        )
    return f", told_ AS (SELECT k, count(*) AS n_told, {', '.join(told)} FROM entries_ GROUP BY k) SELECT tablet_id, {', '.join(said)} FROM (SELECT *, CASE tx WHEN '' THEN 'unknown transaction' ELSE tx END AS tx_ FROM done_) LEFT JOIN told_ ON k = o_orderkey"


#: What tablets say in each tested field.
_SAID = {
    "transaction_type": "tx", "source_office": _side("s"), "receiver_office": _side("r"), "ruler": "ruler_", "destination": _DESTINATION, "destination_category": _KIND,
    "source": _if("true", "source"), "receiver": _if("has_receiver", "receiver"), "commissioner": _if("with_maszkim", "deliverer"), "intermediary": _if("with_giri", "receiver"), "deliverer": _if("urgent AND NOT royal", "deliverer"),
    "total_animals": "total_animals::STRING", "month_number": "month_::STRING", "regnal_year": "reign_::STRING", "divine_recipients": _if("true", "deity"),
}

_SHIPPED = "SELECT {key} AS key, n, period AS period_y, period || '.' || lpad(month_::STRING, 2, '0') AS period_m FROM shipped_ WHERE {key} <> ''"
_NAMES = r"""WITH t AS (
  SELECT c_custkey AS seq, 'lu₂-ša' || (c_custkey % 13) AS form, 'Lu' || (c_nationkey % 4) AS canonical,
         CASE WHEN c_custkey % 11 = 0 THEN 'DN' ELSE CASE c_custkey % 3 WHEN 0 THEN 'PN' WHEN 1 THEN 'GN' ELSE 'N' END END AS pos FROM customer
), f AS (
  SELECT seq, form, canonical, pos FROM t WHERE pos <> 'N' UNION ALL SELECT seq, 'lu2-sza' || (seq % 13), canonical, pos FROM t WHERE pos <> 'N'
), g AS (
  SELECT form, canonical, count(*) AS n, min(seq) AS first, arg_max(pos, seq) AS pos FROM f GROUP BY ALL
), names AS (
  SELECT form, canonical, pos, CASE pos WHEN 'PN' THEN 'personal_name' WHEN 'GN' THEN 'geographic_name' ELSE 'deity_name' END AS category, n AS attestations
  FROM g QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, first) = 1
) """

ORACLES = {
    "animal_totals_by_species": base("SELECT species AS animal, count(*) AS n_entries, sum(n)::BIGINT AS total FROM entries_ GROUP BY species"),
    "csv_documents": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, n_chars FROM documents",
    "content_lines": base("SELECT tablet_id, CASE WHEN blank THEN 0 ELSE n_items + len(reverse) END AS n_lines, CASE WHEN blank THEN 0 ELSE n_damaged + n_lost END AS n_damaged FROM done_"),
    "damage_strip": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<<[^>]*>>', '', 'g'), '<([^>]*)>', '\1', 'g'), '\[([^\]]*)\]', '\1', 'g'), '[#?!]', '', 'g'), '\s+', ' ', 'g'))) AS stripped FROM documents""",
    "damage_report": base("SELECT tablet_id, CASE WHEN blank THEN 0 ELSE n_damaged END AS damaged_signs, CASE WHEN blank THEN 0 ELSE n_lost END AS broken_signs, CASE WHEN with_break AND NOT blank THEN 1 ELSE 0 END AS missing_lines, round(preservation * 1000)::BIGINT AS preservation_1000 FROM done_"),
    "edge_totals": base("SELECT tablet_id, edge AS edge_total FROM done_"),
    "transaction_types": base("SELECT tablet_id, tx AS transaction_type FROM done_"),
    "date_fields": base("SELECT tablet_id, CASE WHEN blank THEN '' ELSE month_name END AS month_name, CASE WHEN blank THEN '' ELSE d::STRING END AS day, CASE WHEN blank THEN '' ELSE 'mu en-{d}inanna ba-hun' END AS year_name FROM done_"),
    "date_codes": base("SELECT tablet_id, ruler_ AS ruler, reign_ AS regnal_year, month_ AS month_number FROM done_"),
    "normalized_persons": base(f", {_PERSONS} SELECT tablet_id, role, name, CASE WHEN length(name) % 2 = 0 THEN upper(name) ELSE '' END AS normalized_name, CASE WHEN length(name) % 2 = 0 THEN 'PN' ELSE '' END AS name_type FROM persons_"),
    "top_names": _NAMES + "SELECT form, canonical, attestations FROM names WHERE pos = 'PN' ORDER BY attestations DESC, form LIMIT 5",
    "persons_by_role": base(f", {_PERSONS} SELECT tablet_id, role, name, title FROM persons_"),
    "office_routing": base(f", {_SIDES} SELECT tablet_id, {_side('s')} AS source_office, {_side('r')} AS receiver_office FROM done_ d"),
    "animal_qualifiers": base("SELECT qualifier, count(*) AS n FROM (SELECT qualifier FROM entries_ WHERE qualifier <> '' UNION ALL SELECT 'ba-usz2' FROM entries_ WHERE dead) GROUP BY 1"),
    "implicit_and_broken_entries": base("SELECT k::STRING AS tablet_id, count(*) FILTER (kind = 'implied') AS n_implied, count(*) FILTER (kind = 'lost') AS n_broken FROM entries_ WHERE kind IN ('implied', 'lost') GROUP BY k"),
    "summary_mode": base("SELECT tablet_id, total_animals, total_animals - certain AS total_animals_uncertain FROM done_ WHERE with_summary AND total > 0 AND NOT blank"),
    "destinations": base(f"SELECT {_DESTINATION} AS destination, {_KIND} AS destination_category, count(*) AS n FROM done_ GROUP BY 1, 2"),
    "divine_recipients": base("SELECT tablet_id, deity FROM done_ WHERE deity <> '' AND NOT blank"),
    "imputed_totals": base("SELECT tablet_id, total_animals, status AS total_animals_status, resolved AS total_animals_resolved, CASE WHEN status = 'imputed' THEN 'edge_total' ELSE '' END AS imputation_method FROM done_"),
    "extraction_scores": base("SELECT tablet_id, confidence AS extraction_score FROM done_"),
    "flat_records": base("""SELECT tablet_id, 'T ' || tablet_id AS designation, ruler_ AS ruler, CASE WHEN reign_ = 0 THEN '' ELSE reign_::STRING END AS regnal_year, CASE WHEN month_ = 0 THEN '' ELSE month_::STRING END AS month_number, tx AS transaction_type,
      CASE WHEN blank THEN '' ELSE source END AS source, CASE WHEN has_receiver THEN receiver ELSE '' END AS receiver, CASE WHEN with_giri AND NOT blank THEN receiver ELSE '' END AS intermediary,
      CASE WHEN with_maszkim AND NOT blank THEN deliverer ELSE '' END AS commissioner, CASE WHEN with_kiszib AND NOT blank THEN receiver ELSE '' END AS sealer, CASE WHEN urgent AND NOT royal AND NOT blank THEN deliverer ELSE '' END AS deliverer,
      CASE WHEN with_giri AND NOT blank THEN 'dub-sar' ELSE '' END AS intermediary_title, total_animals::STRING AS total_animals, CASE WHEN status = 'incomplete' THEN 'NaN' ELSE resolved::STRING END AS total_animals_resolved,
      CASE WHEN edge = 0 THEN '' ELSE edge::STRING END AS edge_total, CASE WHEN with_summary AND total > 0 AND NOT blank THEN '1' ELSE '0' END AS has_summary_line, CASE WHEN blank THEN '0' ELSE '1' END AS has_transliteration, confidence AS extraction_score FROM done_"""),
    "flat_records_whole": base(f""", {_SIDES}, detail_ AS (SELECT e.k, string_agg(CASE WHEN e.damaged AND d.status = 'imputed' THEN '[imp:' || (d.edge - d.certain)::STRING || ']' ELSE e.n::STRING END || '×' || species || CASE WHEN len({_QUALIFIERS}) > 0 THEN '-' || array_to_string({_QUALIFIERS}, '-') ELSE '' END, ', ' {_IN_ORDER}) AS detail,
        any_value(species) FILTER (damaged) AS lost_species FROM entries_ e JOIN done_ d ON e.k = d.o_orderkey GROUP BY e.k)
      SELECT tablet_id, 'T ' || tablet_id AS designation, {_DATE} AS date_of_origin, ruler_ AS ruler, CASE WHEN reign_ = 0 THEN '' ELSE reign_::STRING END AS regnal_year, CASE WHEN month_ = 0 THEN '' ELSE month_::STRING END AS month_number, {_if("true", "d.d::STRING")} AS day, tx AS transaction_type,
      {_if("true", "source")} AS source, {_if("has_receiver", "receiver")} AS receiver, {_if("with_giri", "receiver")} AS intermediary, {_if("with_maszkim", "deliverer")} AS commissioner, {_if("with_kiszib", "receiver")} AS sealer, {_if("urgent AND NOT royal", "deliverer")} AS deliverer,
      {_if("true", "source")} AS source_normalized, {_if("has_receiver", "receiver")} AS receiver_normalized, {_if("with_giri", "receiver")} AS intermediary_normalized, {_if("with_maszkim", "deliverer")} AS commissioner_normalized,
      '' AS source_title, '' AS receiver_title, {_if("with_giri", "'dub-sar'")} AS intermediary_title, {_side("s")} AS source_office, {_side("r")} AS receiver_office, coalesce(detail, '') AS animals_detail,
      total_animals::STRING AS total_animals, certain::STRING AS total_animals_certain, (total_animals - certain)::STRING AS total_animals_uncertain, CASE WHEN status = 'incomplete' THEN 'NaN' ELSE resolved::STRING END AS total_animals_resolved, status AS total_animals_status,
      CASE WHEN status = 'imputed' THEN 'edge_total' ELSE '' END AS imputation_method, CASE WHEN status = 'imputed' THEN lost_species ELSE '' END AS imputation_target, CASE WHEN edge = 0 THEN '' ELSE edge::STRING END AS edge_total,
      CASE WHEN with_summary AND total > 0 AND NOT blank THEN '1' ELSE '0' END AS has_summary_line, '0' AS has_sza3_bi_ta, {_if("true", "deity")} AS divine_recipients, {_DESTINATION} AS destination, {_KIND} AS destination_category, {_if("true", "month_name")} AS month_name,
      {_if("true", "'mu en-{d}inanna ba-hun'")} AS year_name, CASE WHEN blank THEN '0' ELSE '1' END AS has_transliteration, confidence AS extraction_score, preservation::DOUBLE::STRING AS preservation_score,
      CASE WHEN blank THEN '0' ELSE n_damaged::STRING END AS damaged_signs, CASE WHEN blank THEN '0' ELSE n_lost::STRING END AS broken_signs FROM done_ d LEFT JOIN detail_ x ON x.k = d.o_orderkey"""),
    "tablet_index": base(f"SELECT tablet_id AS id, 'T ' || tablet_id AS designation, {_DATE} AS date, tx, total_animals AS animals, confidence FROM done_ WHERE NOT blank"),
    "transactions_by_period": base("SELECT period, tx, count(*) AS tablets FROM (SELECT DISTINCT tablet, period_y AS period, tx FROM contrib_) GROUP BY 1, 2"),
    "destination_category_timeline": base(_timeline(_SHIPPED.format(key=f"({_KIND})"), "key", 1)),
    "person_summaries": base(f""", {_PERSONS} SELECT tablet_id, name, role, title, '' AS normalized, {_case("name", {n: b for n, (_, b) in L.OFFICE_OF.items()}, "''")} AS office, {_case("name", {n: o for n, (o, _) in L.OFFICE_OF.items()}, "''")} AS bureau,
      replace(replace({_case("role", L.ROLE_EXPLANATIONS, "''")}, '{{name}}', name), '{{transaction_keyword}}', tx) AS explanation FROM persons_ JOIN done_ USING (tablet_id)"""),
    "plain_summary": base(_sentences()),
    "field_accuracy_whole": base(f", {_SIDES}, said_ AS (SELECT unnest([{', '.join(_text(f) for f in _SAID)}]) AS field, unnest([{', '.join(_SAID.values())}]) AS said, unnest([{', '.join(_text(EXPECTED[f]) for f in _SAID)}]) AS want FROM done_ d) SELECT field, count(*) AS tested, count(*) FILTER (lower(said) = lower(want)) AS passed FROM said_ GROUP BY field"),
    "linked_pairs": base(""", r_ AS (SELECT *, d AS day_, CASE WHEN has_receiver THEN receiver END AS rcv FROM done_ WHERE NOT blank AND ruler_ <> '' AND status <> 'incomplete' AND resolved <> 0)
      SELECT a.tablet_id AS tablet_a, b.tablet_id AS tablet_b, 'T ' || a.tablet_id AS designation_a, 'T ' || b.tablet_id AS designation_b, a.ruler_ AS ruler, a.reign_::STRING AS regnal_year, a.month_::STRING AS month, a.day_::STRING AS day,
             a.resolved AS total_animals, a.tx AS tx_a, b.tx AS tx_b, CASE WHEN a.source = b.source THEN '1' ELSE '0' END AS source_match, CASE WHEN coalesce(a.rcv = b.rcv, false) THEN '1' ELSE '0' END AS receiver_match,
             'date|quantity' || CASE WHEN a.source = b.source THEN '|source' ELSE '' END || CASE WHEN coalesce(a.rcv = b.rcv, false) THEN '|receiver' ELSE '' END AS anchors_matched,
             2 + (a.source = b.source)::INT + coalesce(a.rcv = b.rcv, false)::INT AS match_strength
      FROM r_ a JOIN r_ b ON a.ruler_ = b.ruler_ AND a.reign_ = b.reign_ AND a.month_ = b.month_ AND a.day_ = b.day_ AND a.resolved = b.resolved AND a.o_orderkey < b.o_orderkey
      WHERE a.source = b.source OR coalesce(a.rcv = b.rcv, false)"""),
    "species_timeline": base(_timeline("SELECT key, n, period_y, period_m FROM contrib_", _SPECIES_CATEGORY, 2)),
    "maintained_timeline": base(_timeline("SELECT key, n, period_y, period_m FROM contrib_", _SPECIES_CATEGORY, 2)),
    "species_timeline_external": base(_timeline(f"SELECT key, n, period_y, period_m FROM contrib_ WHERE {_EXTERNAL} AND tablet NOT IN ('1', '2', '4')", _SPECIES_CATEGORY, 2)),
    "timeline_totals": base(""", keys_ AS (SELECT key FROM contrib_ GROUP BY key HAVING count(*) >= 2), u_ AS (
      SELECT 'year' AS granularity, period_y AS period, n, tablet, key FROM contrib_ UNION ALL SELECT 'month', period_m, n, tablet, key FROM contrib_)
      SELECT granularity, period, total_count, tablets, round_even(round_even(total_count / tablets, 1) * 10, 0)::BIGINT AS ratio_10 FROM (
      SELECT granularity, period, coalesce(sum(n) FILTER (key IN (SELECT key FROM keys_)), 0)::BIGINT AS total_count, count(DISTINCT tablet) AS tablets FROM u_ GROUP BY 1, 2)"""),
    "top_contributors": base("SELECT key, row_number() OVER (PARTITION BY key ORDER BY n DESC)::INT AS rank, n FROM contrib_ QUALIFY rank <= 8"),
    "timeline_cell": base("SELECT tablet, n, tx, (SELECT sum(n) FROM contrib_ WHERE key = 'udu' AND period_y = 'AS.08')::BIGINT AS total_count, (SELECT count(*) FROM contrib_ WHERE key = 'udu' AND period_y = 'AS.08') AS total_tablets FROM contrib_ WHERE key = 'udu' AND period_y = 'AS.08' ORDER BY n DESC, pos LIMIT 100"),
    "deity_timeline": base(_timeline(_SHIPPED.format(key="deity"), _DEITY_CATEGORY, 1)),
    "destination_timeline": base(_timeline(_SHIPPED.format(key=f"({_DESTINATION})") + " AND tx IN ('transfer', 'receipt')", _PLACE_CATEGORY, 1)),
    "period_list": base("SELECT DISTINCT 'year' AS granularity, period, (r_idx * 100 + reign_)::BIGINT AS ord FROM done_ WHERE r_idx >= 0 UNION SELECT 'month', period || '.' || lpad(month_::STRING, 2, '0'), ((r_idx * 100 + reign_) * 100 + month_)::BIGINT FROM done_ WHERE r_idx >= 0"),
    "official_activity": base(f""", {_OFFICIALS} SELECT official, string_split(official, '#')[1] AS atf_name, any_value({_OFFICE}) AS office, any_value(CASE WHEN official LIKE '%#S' THEN 'Shepherds-LuNingirsu' ELSE branch END) AS sub_office,
      count(*) FILTER (role = 'source') AS as_source, count(*) FILTER (role = 'receiver') AS as_receiver, count(*) FILTER (role = 'intermediary') AS as_intermediary, count(DISTINCT tablet_id) AS total_tablets,
      arg_min(period, ord) AS first_period, arg_max(period, ord) AS last_period, min(ord) AS first_year_idx, max(ord) AS last_year_idx,
      any_value(CASE {_OFFICE} WHEN 'C' THEN 'Chief Official' WHEN 'D' THEN 'Disbursal Office' WHEN 'S' THEN 'Shepherds Office' ELSE 'Dead Animals Office' END) AS office_label FROM mention_ GROUP BY official"""),
    "official_edges": base(f", {_OFFICIALS} SELECT s.official AS source, r.official AS target, count(*) AS n FROM mention_ s JOIN mention_ r USING (tablet_id) WHERE s.role = 'source' AND r.role = 'receiver' AND s.official <> r.official GROUP BY 1, 2"),
    "officials_by_period": base(f", {_OFFICIALS} SELECT official, period, count(DISTINCT tablet_id) AS tablets FROM mention_ GROUP BY 1, 2"),
    "tenure_split": base(f", {_OFFICIALS} SELECT official, period, count(DISTINCT tablet_id) AS tablets FROM mention_ WHERE official LIKE 'in-ta-e3-a%' GROUP BY 1, 2"),
    "corpus_stats": base("""SELECT 'total_tablets' AS measure, '' AS key, count(*)::BIGINT AS value FROM done_ WHERE NOT blank UNION ALL SELECT 'total_animals', '', sum(total_animals)::BIGINT FROM done_ WHERE NOT blank
      UNION ALL SELECT 'by_transaction', tx, count(*) FROM done_ WHERE NOT blank GROUP BY tx UNION ALL SELECT 'by_confidence', confidence, count(*) FROM done_ WHERE NOT blank GROUP BY confidence"""),
    "data_quality_issues": base("""SELECT type, severity, count(*) AS n FROM (
      SELECT 'total_mismatch' AS type, CASE WHEN abs(edge - total_animals) <= 2 THEN 'info' WHEN preservation < 0.8 THEN 'warning' WHEN abs(edge - total_animals) > 5 THEN 'error' ELSE 'warning' END AS severity FROM done_ WHERE edge > 0 AND total_animals > 0 AND edge <> total_animals AND preservation >= 0.6
      UNION ALL SELECT 'implicit_count', 'info' FROM entries_ WHERE kind IN ('implied', 'lost')
      UNION ALL SELECT 'possible_theophoric', 'info' FROM done_ WHERE deity = '{d}inanna' AND NOT blank) GROUP BY 1, 2"""),
    "issue_lines": base(f"""SELECT tablet_id, 'total_mismatch' AS type, CASE WHEN abs(edge - total_animals) <= 2 THEN 'info' WHEN preservation < 0.8 THEN 'warning' WHEN abs(edge - total_animals) > 5 THEN 'error' ELSE 'warning' END AS severity,
        edge::STRING AS line, 'Edge total ' || edge || ' ≠ extracted total ' || total_animals || ' (diff=' || abs(edge - total_animals) || ')' AS message FROM done_ WHERE edge > 0 AND total_animals > 0 AND edge <> total_animals AND preservation >= 0.6
      UNION ALL SELECT tablet_id, 'implicit_count', 'info', {_ITEM_TEXT}, 'Implicit count=1 for ' || species FROM items_ JOIN tabs_ ON l_orderkey = o_orderkey WHERE NOT blank AND (kind = 'lost' OR (kind = 'implied' AND NOT with_summary))
      UNION ALL SELECT tablet_id, 'possible_theophoric', 'info', 'mu en-{{d}}inanna ba-hun', 'Deity {{d}}inanna may be part of a personal name' FROM done_ WHERE deity = '{{d}}inanna' AND NOT blank"""),
    "name_dictionary": _NAMES + "SELECT * FROM names",
    "name_summary": _NAMES + "SELECT 'forms' AS measure, '' AS key, count(*)::BIGINT AS value FROM names UNION ALL SELECT 'attestations', '', sum(attestations)::BIGINT FROM names UNION ALL SELECT 'category', category, count(*) FROM names GROUP BY category UNION ALL SELECT 'pos', pos, count(*) FROM names GROUP BY pos",
    "name_lookup": _NAMES + "SELECT s_suppkey, canonical, pos, attestations FROM supplier LEFT JOIN names ON form = CASE s_suppkey % 3 WHEN 1 THEN 'lu2-sza' ELSE 'lu₂-ša' END || (s_suppkey % 15)",
    "glossary_categories": "SELECT CASE p_partkey % 5 WHEN 1 THEN 'profession' WHEN 4 THEN 'other' ELSE 'animal' END AS category, count(*) AS n, sum(p_size)::BIGINT AS attestations, 'udu2' AS first_form FROM part WHERE p_partkey % 5 <> 3 GROUP BY 1",
    "lemma_walk": "SELECT 't' || s_suppkey AS doc, k AS seq, CASE k WHEN 1 THEN 'a' || s_suppkey WHEN 2 THEN 'b' || s_nationkey ELSE 'c' END AS form, 'C' AS cf, 'PN' AS pos FROM supplier, (SELECT unnest([1, 2, 3])::BIGINT AS k)",
    "line_types": base("""SELECT type, section, sum(n)::BIGINT AS n FROM (
      SELECT 'structural' AS type, 'obverse' AS section, 2 + with_break::INT AS n FROM done_ WHERE NOT blank UNION ALL SELECT 'metadata', 'obverse', 1 FROM done_ WHERE NOT blank UNION ALL SELECT CASE WHEN kind = 'derived' AND qualifier <> '' THEN 'person_role' ELSE 'content' END, 'obverse', 1 FROM items_ JOIN done_ ON l_orderkey = o_orderkey WHERE NOT blank
      UNION ALL SELECT 'structural', 'reverse', 1 FROM done_ WHERE NOT blank UNION ALL SELECT 'summary', 'reverse', 1 FROM done_ WHERE NOT blank AND with_summary AND total > 0
      UNION ALL SELECT 'person_role', 'reverse', 1 + with_giri::INT + with_kiszib::INT FROM done_ WHERE NOT blank UNION ALL SELECT 'content', 'reverse', with_maszkim::INT + (deity <> '')::INT + (o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::INT + 1 + urgent::INT FROM done_ WHERE NOT blank
      UNION ALL SELECT 'transaction', 'reverse', 1 FROM done_ WHERE NOT blank AND NOT urgent UNION ALL SELECT 'date', 'reverse', 1 FROM done_ WHERE NOT blank UNION ALL SELECT 'year', 'reverse', 1 FROM done_ WHERE NOT blank
      UNION ALL SELECT 'structural', 'seal', 1 FROM done_ WHERE NOT blank AND with_seal UNION ALL SELECT 'content', 'seal', 1 FROM done_ WHERE NOT blank AND with_seal UNION ALL SELECT 'structural', 'edge', 1 FROM done_ WHERE NOT blank AND with_seal
      UNION ALL SELECT 'structural', 'left_edge', 1 FROM done_ WHERE NOT blank AND edge_text IS NOT NULL UNION ALL SELECT 'content', 'left_edge', 1 FROM done_ WHERE NOT blank AND edge_text IS NOT NULL
    ) WHERE n > 0 GROUP BY 1, 2"""),
    "stratified_sample": base(""", h_ AS (SELECT tablet_id, ruler_ AS ruler, o_orderkey AS pos, count(*) OVER (PARTITION BY ruler_) AS n, count(*) OVER () AS t, row_number() OVER (PARTITION BY ruler_ ORDER BY o_orderkey) AS r FROM done_ WHERE confidence = 'high' AND NOT blank)
      SELECT tablet_id, ruler, pos FROM h_ WHERE r <= greatest(1, round_even(n / t * 200, 0)) ORDER BY ruler, pos LIMIT 200"""),
    "field_accuracy": base("SELECT 'ruler' AS field, count(*) AS tested, count(*) AS passed FROM done_ UNION ALL SELECT 'total_animals', count(*), count(*) FILTER (total_animals = edge) FROM done_ UNION ALL SELECT 'divine_recipients', count(*), count(*) FILTER (deity = '{d}inanna' AND NOT blank) FROM done_"),
    "snapshot_changes_whole": base(f""", {_SIDES}, f_ AS (SELECT tx, {_if("true", "source")} AS source, {_if("has_receiver", "receiver")} AS receiver, total_animals, {_side("s")} AS source_office, {_side("r")} AS receiver_office FROM done_ d WHERE tablet_id::BIGINT % 2 = 0)
      SELECT 'transaction_type' AS field, count(*) AS n FROM f_ UNION ALL SELECT 'source', count(*) FILTER (source <> '') FROM f_ UNION ALL SELECT 'receiver', count(*) FILTER (receiver <> '') FROM f_
      UNION ALL SELECT 'total_animals', count(*) FILTER (total_animals <> 0) FROM f_ UNION ALL SELECT 'source_office', count(*) FILTER (source_office <> '') FROM f_ UNION ALL SELECT 'receiver_office', count(*) FILTER (receiver_office <> '') FROM f_"""),
    "snapshot_changes": base("SELECT * FROM (SELECT 'transaction_type' AS field, count(*) FILTER (tx = 'transfer') AS n FROM done_ UNION ALL SELECT 'receiver', count(*) FILTER (has_receiver AND receiver = 'du-ga') FROM done_)"),
}
