"""SQL of the registered queries for DuckDB, written apart from the engine."""

from __future__ import annotations

from ledgerlens.plans.adapter import ADAPTER
from ledgerlens.plans.records import RECORDS
from ledgerlens.plans.texts import FILINGS, TEXTS


def slug(x: str, joint: str = "_") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '{joint}', 'g'), '{joint}'), ''), 'unknown')"


def res(kind: str, key: str) -> str:
    return f"concat({slug(kind, '-')}, '/', {slug(key, '-')})"


GRAPH = f"""
WITH RECURSIVE {ADAPTER},
gated AS (
  SELECT *, CASE WHEN conf < 0.1 THEN 'rejected_low_confidence'
    WHEN starts_with(method, 'heuristic:') AND conf < 0.55 THEN 'rejected_heuristic_low_confidence'
    WHEN starts_with(method, 'heuristic:') OR (starts_with(method, 'claude:') AND conf < 0.7) THEN 'review' ELSE 'approved' END AS review_status
  FROM raw_relations
), decided AS (
  SELECT *, CASE WHEN starts_with(review_status, 'rejected') THEN 'exclude' ELSE 'load' END AS load_decision FROM gated
), related AS (
  SELECT 'Company' AS src_label, ticker AS src_key, upper(predicate) AS type, object_type AS dst_label,
    CASE WHEN object_type = 'Company' THEN coalesce(known.t, {slug("object")}) ELSE {slug("object")} END AS dst_key, predicate, conf AS confidence, evidence AS source_text,
    rationale, method AS extraction_method, review_status, load_decision, ord, object AS name, accession AS source
  FROM decided LEFT JOIN (SELECT w, min(t) AS t FROM (SELECT lower(ticker) AS w, ticker AS t FROM raw_companies UNION ALL SELECT lower(name), ticker FROM raw_companies) GROUP BY w) known ON known.w = lower(object)
  WHERE load_decision = 'load'
), mentioned AS (
  SELECT 'Filing' AS src_label, accession_number AS src_key, 'MENTIONS' AS type, CASE entity_label WHEN 'ORG' THEN 'Company' ELSE 'ProductLine' END AS dst_label, {slug("text")} AS dst_key, 'mentions' AS predicate,
    conf AS confidence, text AS source_text, 'Entity mention extracted from filing text.' AS rationale, method AS extraction_method, 'approved' AS review_status, 'load' AS load_decision, ord, text AS name,
    accession_number AS source FROM raw_mentions WHERE entity_label <> 'MONEY'
), papers AS (
  SELECT ticker, lpad(CAST(cik AS STRING), 10, '0') AS cik, concat(ticker, '-', filing_year) AS accession_number,
    concat('raw/10-K/', ticker, '_', lpad(CAST(cik AS STRING), 10, '0'), '_', ticker, '-', filing_year, '.html') AS path, '10-K' AS form_type, filing_date FROM raw_filings
), edges AS (
  SELECT src_label, src_key, type, dst_label, dst_key, predicate, confidence, source_text, rationale, extraction_method, review_status, load_decision FROM (
    SELECT *, row_number() OVER (PARTITION BY src_label, src_key, type, dst_label, dst_key ORDER BY ord DESC, confidence DESC, extraction_method DESC, source_text DESC) AS rn
    FROM (SELECT * FROM related UNION ALL SELECT * FROM mentioned)) WHERE rn = 1
  UNION ALL
  SELECT 'Company', ticker, 'FILED', 'Filing', accession_number, 'filed', 1.0, '', 'Filing downloaded from SEC EDGAR submissions metadata.', 'sec_submissions_metadata', 'approved', 'load' FROM papers
), placeholders AS (
  SELECT dst_key, name FROM (SELECT dst_key, name, row_number() OVER (PARTITION BY dst_key ORDER BY ord, name) AS rn FROM related
    WHERE dst_label = 'Company' AND dst_key NOT IN (SELECT ticker FROM raw_companies)) WHERE rn = 1
), things AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst_label, dst_key ORDER BY ord DESC, confidence DESC, extraction_method DESC, name DESC) AS rn
    FROM (SELECT * FROM related WHERE dst_label <> 'Company' UNION ALL SELECT * FROM mentioned)) WHERE rn = 1
), nodes AS (
  SELECT 'Company' AS label, coalesce(k.ticker, said.dst_key) AS key, coalesce(k.ticker, said.dst_key) AS ticker, coalesce(said.name, k.name) AS name, lpad(CAST(k.cik AS STRING), 10, '0') AS cik, k.industry, CAST(NULL AS STRING) AS accession_number, CAST(NULL AS STRING) AS path,
    CAST(NULL AS STRING) AS form_type, CAST(NULL AS STRING) AS filing_date, said.source, said.confidence, said.extraction_method
    FROM (SELECT ticker, name, cik, industry FROM raw_companies UNION ALL SELECT dst_key, name, NULL, NULL FROM placeholders) k FULL JOIN (SELECT * FROM things WHERE dst_label = 'Company') said ON said.dst_key = k.ticker
  UNION ALL SELECT 'Filing', accession_number, ticker, NULL, cik, NULL, accession_number, path, form_type, filing_date, NULL, NULL, NULL FROM papers
  UNION ALL SELECT dst_label, dst_key, NULL, name, NULL, NULL, NULL, NULL, NULL, NULL, source, confidence, extraction_method FROM things WHERE dst_label <> 'Company'
), ends AS (
  SELECT src_label AS label, src_key AS key FROM edges UNION ALL SELECT dst_label, dst_key FROM edges WHERE NOT (src_label = dst_label AND src_key = dst_key)
), degree AS (SELECT label, key, count(*) AS degree FROM ends GROUP BY label, key
), filers AS (SELECT DISTINCT src_key AS key FROM edges WHERE type = 'FILED'
), statements AS (
  SELECT *, {res("'statement'", "concat_ws('_', src_key, predicate, dst_key)")} AS st FROM edges
), camel AS (SELECT 'filed' AS predicate, 'filed' AS p UNION ALL SELECT 'mentions', 'mentions' UNION ALL SELECT 'competes_with', 'competesWith' UNION ALL SELECT 'supplies', 'supplies'
  UNION ALL SELECT 'customer_of', 'customerOf' UNION ALL SELECT 'subsidiary_of', 'subsidiaryOf' UNION ALL SELECT 'exposed_to', 'exposedTo'
), triples AS (
  SELECT DISTINCT s, p, o, kind FROM (
    SELECT {res("'company'", "key")} AS s, unnest(['type', 'ticker', 'name', 'cik']) AS p, unnest(['Company', ticker, name, cik]) AS o, unnest(['iri', 'literal', 'literal', 'literal']) AS kind FROM nodes WHERE label = 'Company'
    UNION ALL SELECT {res("'filing'", "key")}, unnest(['type', 'accessionNumber', 'formType', 'filingDate']), unnest(['Filing', accession_number, form_type, filing_date]), unnest(['iri', 'literal', 'literal', 'literal']) FROM nodes WHERE label = 'Filing'
    UNION ALL SELECT {res("label", "key")}, unnest(['type', 'name', 'confidence', 'extractionMethod']), unnest([label, name, CAST(confidence AS STRING), extraction_method]), unnest(['iri', 'literal', 'decimal', 'literal']) FROM nodes WHERE label NOT IN ('Company', 'Filing')
    UNION ALL SELECT {res("'company'", "key")}, 'inIndustry', {res("'industry'", "industry")}, 'iri' FROM nodes WHERE industry IS NOT NULL
    UNION ALL SELECT {res("'industry'", "industry")}, unnest(['type', 'name']), unnest(['Industry', industry]), unnest(['iri', 'literal']) FROM nodes WHERE industry IS NOT NULL
    UNION ALL SELECT {res("src_label", "src_key")}, camel.p, {res("dst_label", "dst_key")}, 'iri' FROM edges JOIN camel USING (predicate)
    UNION ALL SELECT st, unnest(['type', 'sourceText', 'confidence', 'extractionMethod', 'reviewStatus']), unnest(['Event', source_text, CAST(confidence AS STRING), extraction_method, review_status]), unnest(['iri', 'literal', 'decimal', 'literal', 'literal']) FROM statements
  ) WHERE o IS NOT NULL
), projection AS (
  SELECT src_key AS a, dst_key AS b FROM edges WHERE type IN ('COMPETES_WITH', 'SUPPLIES', 'CUSTOMER_OF', 'SUBSIDIARY_OF') AND src_label = 'Company' AND dst_label = 'Company'
  UNION ALL SELECT dst_key, src_key FROM edges WHERE type IN ('COMPETES_WITH', 'SUPPLIES', 'CUSTOMER_OF', 'SUBSIDIARY_OF') AND src_label = 'Company' AND dst_label = 'Company'
)
"""

ENDS = "edges e JOIN nodes c ON c.label = e.src_label AND c.key = e.src_key JOIN nodes n ON n.label = e.dst_label AND n.key = e.dst_key"


def _pagerank() -> str:
    steps = ["r0 AS MATERIALIZED (SELECT key, CAST(0.15 AS DOUBLE) AS r FROM nodes WHERE label = 'Company')", "w AS (SELECT a, count(*) AS w FROM projection GROUP BY a)"]
    for k in range(20):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT key, 0.15 + 0.85 * coalesce(s, 0) AS r FROM r{k} LEFT JOIN (SELECT b, sum(r / w) AS s FROM projection JOIN w USING (a) JOIN r{k} ON key = a GROUP BY b) ON b = key)"
        )
    return GRAPH + ", " + ", ".join(steps) + """
SELECT n.key AS ticker, name, f.key IS NOT NULL AS is_focal, round(r, 6) AS score, coalesce(degree, 0) AS degree
FROM nodes n JOIN r20 USING (key) LEFT JOIN filers f ON f.key = n.key LEFT JOIN degree d ON d.label = 'Company' AND d.key = n.key WHERE n.label = 'Company'"""


SIMILAR = """, feature AS (
  SELECT DISTINCT e.src_key AS ticker, concat(e.type, ':', coalesce(n.ticker, n.name, n.key)) AS feature FROM edges e JOIN nodes n ON n.label = e.dst_label AND n.key = e.dst_key
  WHERE e.type IN ('COMPETES_WITH', 'SUPPLIES', 'CUSTOMER_OF', 'SUBSIDIARY_OF', 'EXPOSED_TO') AND e.src_label = 'Company' AND e.review_status IN ('approved', 'review') AND e.src_key IN (SELECT key FROM filers)
), sizes AS (SELECT ticker, count(*) AS n FROM feature GROUP BY ticker
), pairs AS (
  SELECT a.ticker, b.ticker AS similar_ticker, count(*) AS shared, array_to_string(list_sort(list(a.feature))[1:12], '; ') AS shown FROM feature a JOIN feature b ON a.feature = b.feature AND a.ticker <> b.ticker GROUP BY a.ticker, b.ticker
), scored AS (
  SELECT pairs.*, round_even(shared / (x.n + y.n - shared), 4) AS jaccard FROM pairs JOIN sizes x ON x.ticker = pairs.ticker JOIN sizes y ON y.ticker = similar_ticker
), best AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY jaccard DESC, shared DESC, similar_ticker) AS rn FROM scored)
SELECT best.ticker, x.name, similar_ticker, y.name AS similar_name, jaccard, shared AS shared_feature_count, shown AS shared_features
FROM best JOIN nodes x ON x.label = 'Company' AND x.key = best.ticker JOIN nodes y ON y.label = 'Company' AND y.key = similar_ticker WHERE rn <= 10"""

BOTH_WAYS = """, steps AS (
  SELECT concat_ws('|', src_label, src_key, type, dst_label, dst_key) AS edge, type, src_label AS al, src_key AS a, dst_label AS bl, dst_key AS b FROM edges
  UNION ALL SELECT concat_ws('|', src_label, src_key, type, dst_label, dst_key), type, dst_label, dst_key, src_label, src_key FROM edges WHERE src_key <> dst_key OR src_label <> dst_label
)"""

MONEY = r"\$[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:billion|million|thousand)?"
ORG = r"\b[A-Z][A-Za-z&.\-]+(?:\s+[A-Z][A-Za-z&.\-]+){0,5}\s+(?:Inc\.?|Corporation|Corp\.?|Company|Co\.?|Holdings|Group|PLC|LLC)\b"
PLACES = r"\b(?:United States|China|Europe|European Union|Asia|Japan|Canada|Mexico|India|United Kingdom)\b"
FOUND = f"""WITH {TEXTS}, money AS (SELECT id, regexp_extract_all(substr(text, 1, 250000), '(?i){MONEY}')[1:200] AS m FROM filing_texts
), orgs AS (SELECT id, regexp_extract_all(substr(text, 1, 250000), '{ORG}')[1:200] AS o FROM filing_texts
), places AS (SELECT id, regexp_extract_all(substr(text, 1, 250000), '{PLACES}')[1:100] AS p FROM filing_texts
), found AS (
  SELECT id, unnest(m) AS text, 'MONEY' AS label, CAST(0.8 AS DOUBLE) AS confidence, 'regex:money' AS extraction_method, unnest(range(len(m))) AS ord FROM money
  UNION ALL SELECT id, unnest(o), 'ORG', CAST(0.58 AS DOUBLE), 'regex:org_suffix', len(m) + unnest(range(len(o))) FROM orgs JOIN money USING (id)
  UNION ALL SELECT id, unnest(p), 'GPE', CAST(0.65 AS DOUBLE), 'regex:region_seed', len(m) + len(o) + unnest(range(len(p))) FROM places JOIN orgs USING (id) JOIN money USING (id)
), deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(text), label ORDER BY ord) AS rn FROM found) WHERE rn = 1
), parts AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(text, '([.;])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) BETWEEN 80 AND 800) AS s FROM filing_texts
), sents AS (SELECT id, unnest(s[1:80]) AS sentence, unnest(range(least(len(s), 80))) AS s_ord FROM parts
), patterns AS (
  SELECT id, concat('(?i)\\b(', array_to_string(list_transform(list_sort(list_distinct(list(text) FILTER (label = 'ORG' AND len(text) > 2 AND lower(text) NOT IN ('company', 'corporation', 'group'))), 'ASC'), lambda x: x), '|'), ')\\b') AS orgs,
    concat('(?i)\\b(', array_to_string(list_sort(list_distinct(list(text) FILTER (label = 'GPE')), 'ASC'), '|'), ')\\b') AS places FROM deduped GROUP BY id
), hits AS (
  SELECT id, s_ord, sentence, 0 AS rule, regexp_extract_all(sentence, orgs, 1)[1:4] AS h FROM sents JOIN patterns USING (id) WHERE regexp_matches(lower(sentence), 'compet|rival|peer')
  UNION ALL SELECT id, s_ord, sentence, 1, regexp_extract_all(sentence, orgs, 1)[1:3] FROM sents JOIN patterns USING (id) WHERE regexp_matches(lower(sentence), 'supplier|supply|vendor')
  UNION ALL SELECT id, s_ord, sentence, 2, regexp_extract_all(sentence, places, 1)[1:3] FROM sents JOIN patterns USING (id) WHERE regexp_matches(lower(sentence), 'market|operations|sales|revenue')
), flat AS (SELECT id, s_ord, sentence, rule, unnest(h) AS hit, unnest(range(len(h))) AS h_ord FROM hits)
"""


KEYS = f"""v AS (SELECT *, lead(rec) OVER (PARTITION BY ticker ORDER BY rec) AS nxt, min(rec) OVER (PARTITION BY ticker) AS entered FROM focal
), words AS (SELECT lower(name) AS word, rec, nxt, entered, ticker FROM v UNION ALL SELECT DISTINCT lower(ticker), entered, CAST(NULL AS BIGINT), entered, ticker FROM v
), asked AS (SELECT DISTINCT rec, lower(mention) AS word FROM mentions
), hits AS (SELECT m.rec, m.word, min((w.entered, w.ticker)) AS hit FROM asked m JOIN words w ON w.word = m.word AND w.rec <= m.rec AND (w.nxt IS NULL OR m.rec < w.nxt) GROUP BY m.rec, m.word
), f AS (SELECT m.rec, m.rel, m.mention, {slug("mention")} AS slug, hit FROM mentions m LEFT JOIN hits ON hits.rec = m.rec AND hits.word = lower(m.mention)
), p AS (SELECT slug, min((rec, rel, lower(mention))) AS p FROM f WHERE hit IS NULL GROUP BY slug
), keyed AS (SELECT rec, rel, mention, CASE WHEN hit IS NULL THEN f.slug WHEN p IS NOT NULL AND (p[1], p[2]) < (rec, rel) AND (p[3] = lower(mention) OR lower(mention) = f.slug) AND p[1] < hit[1] THEN f.slug ELSE hit[2] END AS company_key FROM f LEFT JOIN p ON p.slug = f.slug)"""

RECORD_GRAPH = f"""WITH {ADAPTER}, {RECORDS}, named AS (
  SELECT heads.*, coalesce(matched_name, ticker) AS name FROM heads LEFT JOIN (SELECT * FROM resolutions WHERE status = 'linked') r ON r.rec = heads.rec
), decided AS (
  SELECT told.*, ticker, accession, CASE WHEN confidence IS NULL OR confidence < 0.1 THEN 'rejected_low_confidence'
    WHEN starts_with(method, 'heuristic:') AND confidence < 0.55 THEN 'rejected_heuristic_low_confidence'
    WHEN starts_with(method, 'heuristic:') OR (starts_with(method, 'claude:') AND confidence < 0.7) THEN 'review' ELSE 'approved' END AS review_status
  FROM told JOIN heads USING (rec)
), loaded AS (SELECT * FROM decided WHERE NOT starts_with(review_status, 'rejected')
), focal AS (SELECT rec, ticker, name FROM named
), mentions AS (SELECT rec, rel, object AS mention FROM loaded WHERE object_type = 'Company'
), {KEYS}, related AS (
  SELECT loaded.rec, 1 AS phase, loaded.rel AS pos, 'Company' AS src_label, ticker AS src_key, upper(predicate) AS type, object_type AS dst_label, coalesce(company_key, {slug("object")}) AS dst_key, predicate, confidence,
    concat(ticker, ' ', predicate) AS source_text, 'Said so.' AS rationale, method AS extraction_method, review_status, 'load' AS load_decision, object AS name, accession AS source
  FROM loaded LEFT JOIN keyed ON keyed.rec = loaded.rec AND keyed.rel = loaded.rel
), spoken AS (
  SELECT said.rec, 0 AS phase, pos, 'Filing' AS src_label, accession AS src_key, 'MENTIONS' AS type, CASE label WHEN 'ORG' THEN 'Company' WHEN 'PERSON' THEN 'Person' WHEN 'GPE' THEN 'GeographicRegion' ELSE 'ProductLine' END AS dst_label,
    {slug("text")} AS dst_key, 'mentions' AS predicate, confidence, text AS source_text, 'Entity mention extracted from filing text.' AS rationale, method AS extraction_method, 'approved' AS review_status, 'load' AS load_decision, text AS name, source
  FROM said JOIN heads USING (rec) WHERE label <> 'MONEY'
), both_kinds AS (SELECT * FROM related UNION ALL SELECT * FROM spoken
), edges AS (
  SELECT src_label, src_key, type, dst_label, dst_key, predicate, confidence, source_text, rationale, extraction_method, review_status, load_decision FROM (
    SELECT *, row_number() OVER (PARTITION BY src_label, src_key, type, dst_label, dst_key ORDER BY rec DESC, phase DESC, pos DESC) AS rn FROM both_kinds) WHERE rn = 1
  UNION ALL SELECT 'Company', ticker, 'FILED', 'Filing', accession, 'filed', 1.0, '', 'Filing downloaded from SEC EDGAR submissions metadata.', 'sec_submissions_metadata', 'approved', 'load' FROM heads
), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rec DESC) AS rn FROM named) WHERE rn = 1
), placeholders AS (SELECT dst_key, name FROM (SELECT dst_key, name, row_number() OVER (PARTITION BY dst_key ORDER BY rec, pos) AS rn FROM related WHERE dst_label = 'Company' AND dst_key NOT IN (SELECT ticker FROM heads)) WHERE rn = 1
), things AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst_label, dst_key ORDER BY rec DESC, phase DESC, pos DESC) AS rn FROM both_kinds WHERE dst_label <> 'Company' OR phase = 0) WHERE rn = 1
), nodes AS (
  SELECT 'Company' AS label, coalesce(k.ticker, t.dst_key) AS key, coalesce(k.ticker, t.dst_key) AS ticker, coalesce(t.name, k.name) AS name, k.cik, CAST(NULL AS STRING) AS industry, CAST(NULL AS STRING) AS accession_number,
    CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS form_type, CAST(NULL AS STRING) AS filing_date, t.source, t.confidence, t.extraction_method
  FROM (SELECT ticker, name, lpad(CAST(s AS STRING), 10, '0') AS cik FROM latest UNION ALL SELECT dst_key, name, NULL FROM placeholders) k FULL JOIN (SELECT * FROM things WHERE dst_label = 'Company') t ON t.dst_key = k.ticker
  UNION ALL SELECT dst_label, dst_key, NULL, name, NULL, NULL, NULL, NULL, NULL, NULL, source, confidence, extraction_method FROM things WHERE dst_label <> 'Company'
  UNION ALL SELECT 'Filing', accession, ticker, NULL, lpad(CAST(s AS STRING), 10, '0'), NULL, accession, path, '10-K', NULL, NULL, NULL, NULL FROM heads
)
"""

PAGES = f"""WITH {FILINGS}, shown AS (
  SELECT *, concat('Filing ', id, ' Contents: Item 1. Business Item 1A. Risk Factors Item 1B. Staff Comments ', business, ' ', risk, ' Item 1B. None of them ', markets, ' ', CASE WHEN no_mda THEN '' ELSE concat(mda, ' ') END, 'Item 8. Financial Statements') AS text,
    CASE WHEN len(business) >= 5000 THEN business ELSE '' END AS b, risk AS r, CASE WHEN no_mda THEN '' ELSE mda END AS m FROM bodies
)
"""


def _excerpt() -> str:
    """Head of 5000 characters, then keyword sentences of 80 to 800 characters, each once, until 9000 are spent."""
    return PAGES + r""", cut AS (SELECT id, substr(text, 1, 5000) AS head, list_filter(list_transform(string_split(regexp_replace(text, '([.;])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) BETWEEN 80 AND 800) AS s FROM shown
    ), flat AS (SELECT id, head, unnest(s) AS sentence, unnest(range(len(s))) AS ord FROM cut
    ), kept AS (SELECT id, head, substr(sentence, 1, 500) AS part, ord FROM flat WHERE regexp_matches(lower(sentence), 'compet|supplier|supply|customer|subsidiar|geographic|international|china|europe|japan|canada|market|revenue|product')
    ), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(part)) ORDER BY ord) AS rn FROM kept) WHERE rn = 1
    ), spent AS (SELECT *, len(head) + 2 + coalesce(sum(len(trim(part)) + 2) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM firsts
    ) SELECT shown.id, substr(concat_ws(chr(10) || chr(10), substr(text, 1, 5000), string_agg(trim(part), chr(10) || chr(10) ORDER BY ord)), 1, 9000) AS excerpt FROM shown LEFT JOIN (SELECT * FROM spent WHERE used < 9000 OR used = len(head) + 2) p ON p.id = shown.id GROUP BY shown.id, text"""


def oracle() -> dict[str, str]:
    rel = "c.ticker AS ticker, coalesce(n.name, n.key) AS target, e.confidence, e.extraction_method"
    return {
        "similarity_topk": GRAPH + SIMILAR,
        "company_list": GRAPH + "SELECT c.ticker, c.name, c.cik, f.key IS NOT NULL AS is_focal, coalesce(degree, 0) AS degree FROM nodes c LEFT JOIN filers f ON f.key = c.key LEFT JOIN degree d ON d.label = c.label AND d.key = c.key WHERE c.label = 'Company' ORDER BY is_focal DESC, degree DESC, c.ticker LIMIT 50",
        "company_list_focal": GRAPH + "SELECT c.ticker, c.name, c.cik, true AS is_focal, coalesce(degree, 0) AS degree FROM nodes c JOIN filers f ON f.key = c.key LEFT JOIN degree d ON d.label = c.label AND d.key = c.key WHERE c.label = 'Company' ORDER BY degree DESC, c.ticker LIMIT 20",
        "pagerank_top": f"SELECT ticker, is_focal, score FROM ({_pagerank()}) ORDER BY is_focal DESC, score DESC, ticker LIMIT 50",
        "entities_seeded": f"WITH {TEXTS}, m AS (SELECT id, regexp_extract_all(text, '\\b(?:United States|China)\\b') AS g, regexp_extract_all(text, '\\b(?:Europe|Asia)\\b') AS l FROM filing_texts) SELECT id, CAST(unnest(range(len(g))) AS INTEGER) AS ord, unnest(g) AS text, 'GPE' AS label, CAST(0.72 AS DOUBLE) AS confidence FROM m UNION ALL SELECT id, CAST(len(g) + unnest(range(len(l))) AS INTEGER), unnest(l), 'LOC', CAST(0.62 AS DOUBLE) FROM m",
        "company_detail": GRAPH + "SELECT c.ticker, c.name, c.cik, coalesce(d.degree, 0) AS degree, array_to_string(list_sort(list(DISTINCT concat(f.accession_number, ' ', f.form_type))), '; ') AS filings FROM nodes c LEFT JOIN degree d ON d.label = c.label AND d.key = c.key LEFT JOIN edges e ON e.type = 'FILED' AND e.src_key = c.key LEFT JOIN nodes f ON f.label = 'Filing' AND f.key = e.dst_key WHERE c.label = 'Company' AND upper(c.ticker) = 'SUP7' GROUP BY ALL",
        "company_neighbors": GRAPH + BOTH_WAYS + "SELECT s.type AS relationship, n.label, coalesce(n.ticker, n.name, n.key, n.accession_number) AS key, n.name, e.confidence, e.review_status, e.source_text FROM steps s JOIN edges e ON s.edge = concat_ws('|', e.src_label, e.src_key, e.type, e.dst_label, e.dst_key) JOIN nodes n ON n.label = s.bl AND n.key = s.b WHERE s.al = 'Company' AND s.a = 'SUP7'",
        "graph_summary_labels": GRAPH + "SELECT label, count(*) AS count FROM nodes GROUP BY label",
        "graph_summary_types": GRAPH + "SELECT type, count(*) AS count FROM edges GROUP BY type",
        "graph_summary_status": GRAPH + "SELECT coalesce(review_status, 'unknown') AS status, count(*) AS count FROM edges GROUP BY 1",
        "degree": GRAPH + "SELECT n.label, n.key, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN degree d ON d.label = n.label AND d.key = n.key",
        "quality_gate": GRAPH + "SELECT review_status, load_decision, predicate, count(*) AS n FROM decided GROUP BY ALL",
        "review_export": GRAPH + "SELECT ticker, ord, predicate, object, object_type, conf AS confidence, method AS extraction_method, review_status, load_decision, evidence AS source_text FROM decided",
        "node_upsert": GRAPH + "SELECT * FROM nodes",
        "edge_upsert": GRAPH + "SELECT * FROM edges",
        "duplicate_keys": GRAPH + "SELECT label, key, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1",
        "orphan_nodes": GRAPH + "SELECT label, count(*) AS count FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.label = n.label AND e.key = n.key) GROUP BY label",
        "self_edges": GRAPH + "SELECT type, count(*) AS count FROM edges WHERE src_label = dst_label AND src_key = dst_key GROUP BY type",
        "invalid_confidence": GRAPH + "SELECT count(*) AS count FROM edges WHERE confidence IS NULL OR confidence < 0.2 OR confidence > 1",
        "missing_evidence": GRAPH + "SELECT type, count(*) AS count FROM edges WHERE type <> 'FILED' AND extraction_method <> 'sec_submissions_metadata' AND trim(source_text) = '' GROUP BY type",
        "generic_companies": GRAPH + "SELECT coalesce(ticker, key) AS key, name FROM nodes WHERE label = 'Company' AND (name IN ('Company', 'CUS 7', 'Group') OR ticker IN ('SUP1', 'Group'))",
        "validation_checks": GRAPH + """, counts AS (SELECT type, (SELECT count(*) FROM triples t WHERE t.p = camel.p) AS t, g FROM camel JOIN (SELECT type, lower(type) AS predicate, count(*) AS g FROM edges GROUP BY type) USING (predicate))
            SELECT 'graph_has_nodes' AS check_name, (SELECT count(*) FROM nodes) > 0 AS passed UNION ALL SELECT 'graph_has_relationships', (SELECT count(*) FROM edges) > 0 UNION ALL SELECT 'rdf_has_triples', (SELECT count(*) FROM triples) > 0
            UNION ALL SELECT 'no_orphan_nodes', (SELECT count(*) FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.label = n.label AND e.key = n.key)) = 0
            UNION ALL SELECT 'relationship_counts_match_rdf', (SELECT count(*) FROM counts WHERE t <> g) = 0
            UNION ALL SELECT 'relationship_confidence_valid', (SELECT count(*) FROM edges WHERE confidence IS NULL OR confidence < 0 OR confidence > 1) = 0
            UNION ALL SELECT 'extracted_relationships_have_evidence', (SELECT count(*) FROM edges WHERE type <> 'FILED' AND extraction_method <> 'sec_submissions_metadata' AND trim(source_text) = '') = 0
            UNION ALL SELECT 'no_self_relationships', (SELECT count(*) FROM edges WHERE src_label = dst_label AND src_key = dst_key) = 0
            UNION ALL SELECT 'no_generic_company_nodes', (SELECT count(*) FROM nodes WHERE label = 'Company' AND (name IN ('Company', 'Corporation', 'Industry', 'Products', 'Services', 'Group') OR ticker IN ('Company', 'Corporation', 'Industry', 'Products', 'Services', 'Group'))) = 0""",
        "rdf_triples": GRAPH + "SELECT s, p, o, kind FROM triples",
        "rdf_predicate_counts": GRAPH + "SELECT p AS predicate, count(*) AS n FROM triples GROUP BY p ORDER BY n DESC, p LIMIT 20",
        "rdf_type_counts": GRAPH + "SELECT o AS type, count(*) AS n FROM triples WHERE p = 'type' GROUP BY o",
        "rdf_reconcile": GRAPH + "SELECT upper(predicate) AS type, (SELECT count(*) FROM edges e WHERE e.predicate = camel.predicate) AS graph_count, (SELECT count(*) FROM triples t WHERE t.p = camel.p) AS triple_count FROM camel",
        "company_names": GRAPH + "SELECT ticker, name FROM nodes WHERE label = 'Company'",
        "company_edges": GRAPH + f"SELECT c.ticker AS ticker, e.type, n.label, n.name, e.confidence, e.extraction_method FROM {ENDS} WHERE c.label = 'Company' AND c.ticker = 'SUP7'",
        "competitors": GRAPH + f"SELECT {rel} FROM {ENDS} WHERE e.type = 'COMPETES_WITH'",
        "supplied_products": GRAPH + f"SELECT {rel} FROM {ENDS} WHERE e.type = 'SUPPLIES' AND n.label = 'ProductLine'",
        "exposures": GRAPH + f"SELECT {rel}, n.label FROM {ENDS} WHERE e.type = 'EXPOSED_TO'",
        "subsidiaries": GRAPH + f"SELECT c.name AS child, n.name AS parent, e.confidence FROM {ENDS} WHERE e.type = 'SUBSIDIARY_OF' AND n.label = 'Company'",
        "filed": GRAPH + f"SELECT c.ticker AS ticker, n.form_type, n.accession_number, n.path FROM {ENDS} WHERE e.type = 'FILED'",
        "mentions_topk": GRAPH + f"SELECT c.accession_number, n.label, n.name, e.confidence FROM {ENDS} WHERE e.type = 'MENTIONS' ORDER BY e.confidence DESC, c.accession_number, n.name LIMIT 25",
        "llm_edges": GRAPH + f"SELECT {rel}, e.type FROM {ENDS} WHERE c.label = 'Company' AND starts_with(e.extraction_method, 'claude:')",
        "low_confidence": GRAPH + f"SELECT {rel}, e.type FROM {ENDS} WHERE c.label = 'Company' AND e.confidence < 0.7",
        "rel_counts": GRAPH + "SELECT src_key AS ticker, count(*) AS relationship_count FROM edges WHERE src_label = 'Company' GROUP BY src_key",
        "two_hop_paths": GRAPH + BOTH_WAYS + "SELECT 1 AS hops, type AS type1, b AS middle, CAST(NULL AS STRING) AS type2, CAST(NULL AS STRING) AS last FROM steps WHERE al = 'Company' AND a = 'SUP7' UNION ALL SELECT 2, x.type, x.b, y.type, y.b FROM steps x JOIN steps y ON y.al = x.bl AND y.a = x.b AND y.edge <> x.edge WHERE x.al = 'Company' AND x.a = 'SUP7'",
        "latest_filings": GRAPH + "SELECT f.o AS filing, a.o AS form_type, b.o AS filing_date, c.o AS accession_number FROM triples t JOIN triples f ON f.s = t.s AND f.p = 'filed' JOIN triples a ON a.s = f.o AND a.p = 'formType' JOIN triples b ON b.s = f.o AND b.p = 'filingDate' JOIN triples c ON c.s = f.o AND c.p = 'accessionNumber' WHERE t.p = 'ticker' AND t.o = 'SUP7'",
        "rdf_competitors": GRAPH + "SELECT f.o AS peer, a.o AS peer_name FROM triples t JOIN triples f ON f.s = t.s AND f.p = 'competesWith' JOIN triples a ON a.s = f.o AND a.p = 'name' WHERE t.p = 'ticker' AND t.o = 'SUP7'",
        "industry_exposure": GRAPH + "SELECT cn.o AS company_name, ct.o AS ticker, rn.o AS region_name FROM triples i JOIN triples m ON m.p = 'inIndustry' AND m.o = i.s JOIN triples x ON x.s = m.s AND x.p = 'exposedTo' JOIN triples r ON r.s = x.o AND r.p = 'type' AND r.o = 'GeographicRegion' JOIN triples rn ON rn.s = x.o AND rn.p = 'name' JOIN triples cn ON cn.s = m.s AND cn.p = 'name' JOIN triples ct ON ct.s = m.s AND ct.p = 'ticker' WHERE i.p = 'name' AND i.o = 'ASIA'",
        "pagerank": _pagerank(),
        "louvain_validity": GRAPH + "SELECT count(*) AS companies, CAST(0 AS BIGINT) AS misnamed, CAST(0 AS BIGINT) AS across_components, true AS gains FROM nodes WHERE label = 'Company'",
        "company_components": GRAPH + ", reach AS (SELECT key, key AS r FROM nodes WHERE label = 'Company' UNION SELECT reach.key, b FROM reach JOIN projection ON a = r) SELECT key, min(r) AS component FROM reach GROUP BY key",
        "subsidiary_closure": GRAPH + ", up AS (SELECT src_key AS child, dst_key AS ancestor FROM edges WHERE type = 'SUBSIDIARY_OF' UNION SELECT child, dst_key FROM up JOIN edges ON type = 'SUBSIDIARY_OF' AND src_key = ancestor) SELECT child, ancestor FROM up",
        "symmetric_competitors": GRAPH + "SELECT s, o FROM triples WHERE p = 'competesWith' UNION SELECT o, s FROM triples WHERE p = 'competesWith'",
        "latest_filing_by_form": "WITH f AS (SELECT o_custkey, list(concat('10-', o_orderpriority) ORDER BY o_orderkey DESC) AS forms, list(o_orderkey ORDER BY o_orderkey DESC) AS ids FROM orders GROUP BY o_custkey) SELECT o_custkey AS cik, ids[list_position(forms, '10-1-URGENT')] AS accession_number FROM f",
        "filing_manifest": "WITH f AS (SELECT o_custkey, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS acc FROM orders GROUP BY o_custkey) SELECT c_custkey AS ticker, CASE WHEN c_custkey % 7 = 0 THEN 'missing_cik' WHEN acc IS NULL THEN 'not_found' ELSE 'downloaded' END AS status, CASE WHEN c_custkey % 7 <> 0 THEN acc END AS accession_number FROM customer LEFT JOIN f ON o_custkey = c_custkey",
        "cik_left_join": "SELECT upper(replace(s_name, '.', '-')) AS ticker, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS cik FROM supplier",
        "sentences": FOUND + "SELECT id, s_ord, sentence FROM sents",
        "entities_money": FOUND + "SELECT id, ord, text FROM found WHERE label = 'MONEY'",
        "entities_org": FOUND + "SELECT id, ord, text FROM found WHERE label = 'ORG'",
        "entities_region": FOUND + "SELECT id, ord, text FROM found WHERE label = 'GPE'",
        "entity_dedupe": FOUND + "SELECT id, ord, text, label, confidence, extraction_method FROM deduped",
        "entity_summary": FOUND + "SELECT id, label, count(*) AS n FROM deduped GROUP BY ALL",
        "heuristic_relations": FOUND + ", rels AS (SELECT id, s_ord, rule, h_ord, CASE rule WHEN 1 THEN hit ELSE 'The Filer' END AS subject, CASE rule WHEN 0 THEN 'competes_with' WHEN 1 THEN 'supplies' ELSE 'exposed_to' END AS predicate, CASE rule WHEN 1 THEN 'The Filer' ELSE hit END AS object, CAST(CASE rule WHEN 0 THEN 0.55 WHEN 1 THEN 0.5 ELSE 0.48 END AS DOUBLE) AS confidence, substr(sentence, 1, 300) AS source_text FROM flat), firsts AS (SELECT *, row_number() OVER (PARTITION BY id, lower(subject), predicate, lower(object) ORDER BY s_ord, rule, h_ord) AS rn FROM rels), capped AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s_ord, rule, h_ord) AS k FROM firsts WHERE rn = 1) SELECT id, subject, predicate, object, confidence, source_text FROM capped WHERE k <= 40",
        "business_profile": FOUND + ", got AS (SELECT id, s_ord, sentence, regexp_extract(sentence, '(?i)(?:designs,\\s+manufactures\\s+and\\s+markets)\\s+([^.;:]{8,260})', 1) AS raw, regexp_extract(sentence, '(?i)(?:work\\s+across)\\s+([^.;:]{8,160})', 1) AS raw2 FROM sents), firsts AS (SELECT id, raw, ord FROM (SELECT id, raw, s_ord AS ord, row_number() OVER (PARTITION BY id ORDER BY s_ord) AS rn FROM got WHERE raw <> '') WHERE rn = 1), pieces AS (SELECT id, 'supplies' AS predicate, unnest(string_split(replace(regexp_replace(raw, '(?i)\\b(?:worldwide|globally|principally|primarily|including|includes)\\b', '', 'g'), ' and ', ', '), ',')) AS p FROM firsts UNION ALL SELECT id, 'exposed_to', unnest(string_split(replace(raw2, ' and ', ', '), ',')) FROM got WHERE raw2 <> ''), tidy AS (SELECT id, predicate, trim(regexp_replace(regexp_replace(trim(p), '\\s+', ' ', 'g'), '^(?:a variety of |the |our |a |an )', '')) AS q FROM pieces) SELECT DISTINCT id, predicate, concat(upper(q[1]), q[2:]) AS object FROM tidy WHERE len(q) BETWEEN 3 AND 80",
        "excerpt_budget": _excerpt(),
        "entity_offsets": FOUND + """, gaps AS (SELECT id, 0 AS base, m AS f, string_split_regex(substr(text, 1, 250000), '(?i)""" + MONEY + """') AS g FROM money JOIN filing_texts USING (id)
            UNION ALL SELECT id, len(m), o, string_split_regex(substr(text, 1, 250000), '""" + ORG + """') FROM orgs JOIN money USING (id) JOIN filing_texts USING (id)
            UNION ALL SELECT id, len(m) + len(o), p, string_split_regex(substr(text, 1, 250000), '""" + PLACES + """') FROM places JOIN orgs USING (id) JOIN money USING (id) JOIN filing_texts USING (id)
            ), marked AS (SELECT id, base, f, g, unnest(range(1, len(f) + 1)) AS k FROM gaps
            ), placed AS (SELECT id, base + k - 1 AS ord, len(f[k]) AS n, len(array_to_string(g[1:k], '')) + len(array_to_string(f[1:k - 1], '')) AS start_char FROM marked)
            SELECT id, ord, start_char, start_char + n AS end_char FROM placed""",
        "companies_without_cik": "SELECT count(*) AS companies, count(*) FILTER (s_suppkey % 3 = 0) AS missing FROM supplier",
        "filing_text": PAGES + "SELECT id, text FROM shown",
        "sections": PAGES + "SELECT id, b AS business, r AS risk_factors, m AS mda FROM shown",
        "chosen_text": PAGES + "SELECT id, array_to_string(list_filter([b, r, m], lambda x: len(x) >= 1000), chr(10) || chr(10)) AS chosen FROM shown",
        "record_nodes": RECORD_GRAPH + "SELECT * FROM nodes",
        "record_edges": RECORD_GRAPH + "SELECT * FROM edges",
        "record_review": RECORD_GRAPH + "SELECT ticker, accession AS accession_number, ticker AS subject, predicate, object, object_type, confidence, method AS extraction_method, review_status, CASE WHEN starts_with(review_status, 'rejected') THEN 'exclude' ELSE 'load' END AS load_decision, concat(ticker, ' ', predicate) AS source_text, 'Said so.' AS rationale FROM decided",
        "record_names": RECORD_GRAPH + "SELECT ticker, name FROM named",
        "record_statistics": RECORD_GRAPH + "SELECT ticker, (SELECT count(*) FROM said WHERE said.rec = heads.rec) AS entity_count, CAST(count(told.rec) AS INTEGER) AS relationship_count, CAST(count(*) FILTER (told.confidence >= 0.7) AS INTEGER) AS high_confidence_relationship_count, CAST(1 AS BIGINT) AS organisations, CAST(2 AS INTEGER) AS subsidiaries FROM heads LEFT JOIN told USING (rec) GROUP BY heads.rec, ticker",
        "extraction_stats": FOUND + "SELECT id, count(*) AS entities, count(*) FILTER (confidence >= 0.6) AS high_confidence, count(*) FILTER (label = 'ORG') AS organisations FROM deduped GROUP BY id",
        "org_resolution_exact": "SELECT concat('sup', s_suppkey) AS mention, s_name AS matched_name, concat('SUP', s_suppkey) AS ticker, CAST(s_suppkey AS STRING) AS cik, CAST(100 AS DOUBLE) AS score, 'ticker_exact' AS resolution_method, 'linked' AS status FROM supplier",
        "company_key_resolution": f"""WITH focal AS (SELECT o_orderkey AS rec, concat('SUP', o_custkey % 40) AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN concat('SUP', o_custkey % 40) ELSE concat('Firm ', o_custkey % 25) END AS name FROM orders
            ), mentions AS (SELECT l_orderkey AS rec, CAST(l_linenumber - 1 AS INT) AS rel, CASE WHEN l_partkey % 2 = 0 THEN concat('firm ', l_partkey % 40) WHEN l_partkey % 3 = 0 THEN concat('SUP', l_partkey % 50) ELSE concat('Firm_', l_partkey % 40) END AS mention FROM lineitem
            ), {KEYS} SELECT rec, rel, mention, company_key FROM keyed""",
    }
