"""The results of the listing queries, stated in SQL."""

from __future__ import annotations

from skeinworks.plans.listings import FOLD, LATEST, OBSERVED, PER_TB, TYPED

_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _float(x: str) -> str:
    """A double as text without trailing zeros."""
    return f"regexp_replace(({x})::double::varchar, '\\.0$', '')"


_INVALID = """CASE WHEN trim(coalesce(source_id, '')) = '' THEN 'source_id' WHEN trim(coalesce(source_key, '')) = '' THEN 'source_key' {more} END"""
_CONDITION = """CASE WHEN trim(condition) IN ('1000', '1500') THEN 'new' WHEN trim(condition) IN ('2000', '2010', '2500') THEN 'refurb'
  WHEN trim(condition) = '3000' THEN 'used' WHEN trim(condition) = '7000' THEN 'parts'
  WHEN lower(title) LIKE '%for parts%' OR lower(title) LIKE '%as-is%' OR lower(title) LIKE '%as is%' THEN 'parts'
  WHEN lower(title) LIKE '%renewed%' OR lower(title) LIKE '%refurbished%' OR lower(title) LIKE '%recertified%' THEN 'refurb'
  WHEN lower(title) LIKE '%new%' THEN 'new' WHEN lower(title) LIKE '%used%' THEN 'used' ELSE '' END"""
_SQUEEZE = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"
_SCORED = """
own AS (SELECT p.*, m.reference AS own_ref, a.reference AS base FROM {rows} p
  LEFT JOIN (SELECT * FROM {medians} WHERE n >= 3) m ON m.bucket = p.bucket AND m.condition = p.condition
  LEFT JOIN (SELECT * FROM {medians} WHERE n >= 3) a ON a.bucket = p.bucket AND a.condition = 'refurb'),
scored AS (SELECT *, coalesce(own_ref, floor(base * CASE condition WHEN 'new' THEN 1.35 WHEN 'used' THEN 0.75 END + 0.5)::bigint) AS reference,
  CASE WHEN own_ref IS NOT NULL THEN 'own' WHEN base IS NOT NULL AND condition IN ('new', 'used') THEN 'anchor' END AS reference_from FROM own)"""
_OFFER_LATEST = """last AS (SELECT * FROM (SELECT id, source_id, price_cents, status, last_seen_ns, min_price_cents, title,
  row_number() OVER (PARTITION BY id ORDER BY last_seen_ns DESC, title DESC, price_cents DESC, min_price_cents DESC, status DESC) AS rn FROM offers WHERE id IS NOT NULL) WHERE rn = 1)"""


_TAGS = f"""tagged AS (SELECT source_id, id, handle, title, fetched_at, variants, coalesce(product_type, '') AS price_kind,
  list_filter(list_transform(CASE WHEN starts_with({_trim("coalesce(tags, '')")}, '[') AND json_valid({_trim("coalesce(tags, '')")}) THEN json_extract_string(tags, '$[*]')
    ELSE string_split({_trim("coalesce(tags, '')")}, ',') END, lambda t: {_trim("t")}), lambda t: t <> '') AS tags FROM products)"""


def _capacity(x: str) -> str:
    pattern = "'(?i)\\b([0-9]+(?:\\.[0-9]+)?)\\s*(TB|GB)\\b'"
    own = f"CASE WHEN lower({_trim(x)}) <> 'default title' THEN {x} END"
    return f"(nullif(regexp_extract({own}, {pattern}, 1), '')::double / CASE WHEN upper(regexp_extract({own}, {pattern}, 2)) = 'GB' THEN 1000.0 ELSE 1.0 END)"


def _surface(recent: int) -> str:
    return f"""WITH {PER_TB},
recent AS (SELECT * FROM typed ORDER BY seen_at DESC, id LIMIT {recent}),
kept AS (SELECT p.* FROM per_tb p JOIN recent r ON r.id = p.id WHERE p.capacity_tb::double >= 6.0),
{_SCORED.format(rows="kept", medians="medians").strip()}
SELECT row_number() OVER (ORDER BY reference IS NULL DESC, cents_per_tb::double / nullif(reference, 0)::double, id) AS rank, id,
       cents_per_tb::double / nullif(reference, 0)::double AS ratio FROM scored"""


_WATCHED = (
    "WITH "
    + PER_TB
    + """,
hits AS (SELECT 'blue' AS watch, 400 AS lim, * FROM typed WHERE contains(lower(title), 'blue')
  UNION ALL SELECT 'bolts', 900, * FROM typed WHERE contains(lower(title), 'bolt')
  UNION ALL SELECT 'all', 1500, * FROM typed),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watch ORDER BY seen_at DESC, id) AS n FROM hits) WHERE n <= lim),
watched AS (SELECT r.watch, p.* FROM recent r JOIN per_tb p ON p.id = r.id WHERE p.capacity_tb::double >= 6.0)
"""
)

ORACLE_SQL = {
    "item_latest": f"WITH {LATEST} SELECT id, source_id, source_key, title, price_cents, condition_raw, seen_at FROM latest",
    "item_validation": f"""SELECT coalesce({_INVALID.format(more="WHEN trim(coalesce(title, '')) = '' THEN 'title' WHEN status IS NULL OR status NOT IN ('active', 'expired') THEN 'status' WHEN price_cents IS NULL OR price_cents < 0 THEN 'price_cents' WHEN min_price_cents IS NULL OR min_price_cents < 0 THEN 'min_price_cents'")}, '') AS invalid_field, count(*) AS n FROM offers GROUP BY 1""",
    "search_text": f"WITH {LATEST} SELECT id, title FROM latest WHERE contains(lower(title), 'red bolt')",
    "search_tokens": "SELECT DISTINCT id, title FROM offers WHERE contains(lower(title), '16t')",
    "search_price_bound": f"WITH {LATEST} SELECT id, price_cents FROM latest WHERE price_cents > 0 AND price_cents <= 1000000",
    "search_since_topk": f"WITH {LATEST} SELECT id, seen_at FROM latest WHERE seen_at >= TIMESTAMP '2000-01-01' ORDER BY seen_at DESC, id LIMIT 500",
    "search_source": f"WITH {LATEST} SELECT id, seen_at FROM latest WHERE source_id = 'shop:7' AND seen_at >= TIMESTAMP '2000-01-01'",
    "deterministic_id": "SELECT DISTINCT source_id, source_key, substring(sha256(source_id || chr(0) || source_key), 1, 16) AS listing_id FROM offers",
    "extract_capacity": f"""
WITH x AS (SELECT DISTINCT id, title, nullif(regexp_extract(title, '([0-9]+(?:\\.[0-9]+)?)\\s*(TB|tb|GB|gb)\\b', 1), '') AS v, upper(regexp_extract(title, '([0-9]+(?:\\.[0-9]+)?)\\s*(TB|tb|GB|gb)\\b', 2)) AS u,
  CASE WHEN regexp_full_match(trim(json_extract_string(aspects_json, '$.capacity_tb')), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim(json_extract_string(aspects_json, '$.capacity_tb'))::double END AS stated FROM offers)
SELECT id, title, coalesce(CASE WHEN stated > 0 THEN {_float("stated")} END, {_float("CASE WHEN u = 'GB' THEN v::double / 1000 ELSE v::double END")}) AS capacity_tb FROM x""",
    "extract_condition": f"SELECT DISTINCT id, title, {_CONDITION} AS condition_name FROM (SELECT id, title, coalesce(condition, '') AS condition FROM offers)",
    "extract_model": """
WITH x AS (SELECT DISTINCT id, concat_ws(' ', title, upper(hint_mpn)) AS words FROM offers)
SELECT id, words, coalesce(nullif(regexp_extract(words, '\\bST\\d{4,5}[A-Z0-9]+\\b'), ''), nullif(regexp_extract(words, '\\bWUH\\d+\\b'), ''), nullif(regexp_extract(words, '\\bWD\\d+\\b'), ''), '') AS model_number FROM x""",
    "tokenize": """
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2))) AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(words)::int AS n_tokens, sha256(coalesce(array_to_string(words, ' '), '')) AS tokens_hash FROM t""",
    "seller_tiers": """
WITH x AS (SELECT id, price_cents, CASE WHEN regexp_full_match(json_extract_string(aspects_json, '$.seller_feedback_pct'), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN json_extract_string(aspects_json, '$.seller_feedback_pct')::double END AS pct FROM offers)
SELECT DISTINCT id, CASE WHEN pct >= 99 THEN 'high' WHEN pct >= 97 THEN 'good' WHEN pct >= 90 THEN 'mixed' WHEN pct IS NOT NULL THEN 'low' END AS feedback_tier,
  CASE WHEN price_cents >= 100000 THEN 'established' WHEN price_cents >= 10000 THEN 'mid' WHEN price_cents IS NOT NULL THEN 'new' END AS volume_tier FROM x""",
    "hard_filter_reasons": f"""
WITH {TYPED}
SELECT id, CASE WHEN price_cents <= 0 THEN 'unpriced' WHEN price_cents > 6000000 THEN 'price' WHEN capacity_tb = '' THEN 'missing:capacity_tb'
  WHEN capacity_tb::double < 6 THEN 'below:capacity_tb' WHEN capacity_tb::double > 40 THEN 'above:capacity_tb' WHEN condition NOT IN ('new', 'refurb') THEN 'condition' ELSE '' END AS reason FROM typed""",
    "reference_median": f"WITH {PER_TB} SELECT bucket, condition, reference, n FROM medians WHERE n >= 3",
    "reference_recent": f"""WITH {PER_TB}
SELECT bucket, condition, floor(median(cents_per_tb) + 0.5)::bigint AS reference, count(*) AS n FROM per_tb
WHERE seen_at >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY AND seen_at <= TIMESTAMP '1998-06-01' GROUP BY ALL HAVING count(*) >= 3""",
    "reference_median_brand": f"""WITH {PER_TB}
SELECT bucket, regexp_extract(title, '(Brand#[0-9]+)', 1) AS brand, condition, floor(median(cents_per_tb) + 0.5)::bigint AS reference, count(*) AS n FROM per_tb GROUP BY ALL HAVING count(*) >= 3""",
    "reference_ratio": f"""WITH {PER_TB},
branded AS (SELECT id, condition, cents_per_tb, bucket || '|' || regexp_extract(title, '(Brand#[0-9]+)', 1) AS bucket FROM per_tb),
chosen AS (SELECT bucket, condition, floor(median(cents_per_tb) + 0.5)::bigint AS reference, count(*) AS n FROM branded GROUP BY ALL),
{_SCORED.format(rows="branded", medians="chosen").strip()}
SELECT id, reference, reference_from, cents_per_tb::double / nullif(reference, 0)::double AS ratio FROM scored""",
    "surface_ranked": _surface(5000),
    "limit_before_rank": _surface(50),
    "watch_candidates": _WATCHED + "SELECT watch, row_number() OVER (PARTITION BY watch ORDER BY cents_per_tb, id) AS rank, id FROM watched",
    "watch_strong": _WATCHED + "SELECT watch, row_number() OVER (PARTITION BY watch ORDER BY cents_per_tb, id) AS rank, id FROM watched WHERE cents_per_tb <= 120000",
    "watch_counts": _WATCHED + "SELECT watch, count(*) AS candidates, count_if(cents_per_tb <= 120000) AS strong FROM watched GROUP BY watch",
    "offer_fold": f"WITH {FOLD} SELECT * FROM fold",
    "offer_expire": f"""WITH {FOLD}
SELECT id, CASE WHEN due THEN 'expired' ELSE 'active' END AS status, CASE WHEN due THEN TIMESTAMP '2001-12-01' END AS expired_at
FROM (SELECT *, source_id = 'shop:3' AND last_seen < TIMESTAMP '2001-12-01' - INTERVAL 500 DAY AS due FROM fold)""",
    "offer_expire_by_source": f"""WITH {FOLD}
SELECT source_id, CASE WHEN epoch_us(last_seen) < epoch_us(TIMESTAMP '2001-12-01') - s_nationkey::bigint * 50 * 86400 * 1000000 THEN 'expired' ELSE 'active' END AS status, count(*) AS n
FROM fold LEFT JOIN supplier ON source_id = 'shop:' || s_suppkey GROUP BY 1, 2""",
    "offer_retention": f"WITH {FOLD} SELECT id, last_seen FROM fold WHERE last_seen >= TIMESTAMP '2001-12-01' - INTERVAL 900 DAY",
    "offer_revival": f"""WITH {OBSERVED},
fold AS (SELECT id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, coalesce(min(nullif(price_cents, 0)), 0) AS min_price_cents FROM observed GROUP BY id)
SELECT id, CASE WHEN last_seen < TIMESTAMP '2000-06-01' - INTERVAL 100 DAY THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN last_seen < TIMESTAMP '2000-06-01' - INTERVAL 100 DAY THEN TIMESTAMP '2000-06-01' END AS expired_at, first_seen, last_seen, min_price_cents FROM fold""",
    "offer_latest": f"WITH {_OFFER_LATEST} SELECT id, source_id, price_cents, status, last_seen_ns, min_price_cents, title FROM last",
    "offer_query_default": f"WITH {_OFFER_LATEST} SELECT id, price_cents FROM last WHERE status = 'active' AND source_id = 'ebay:us'",
    "offers_by_product": """
SELECT provisional_key, count(*) AS n_offers, count(DISTINCT seller) AS n_sellers, min(nullif(price_cents, 0)) AS least_price_cents
FROM (SELECT DISTINCT id, provisional_key, seller, price_cents FROM offers) WHERE trim(coalesce(provisional_key, '')) <> '' GROUP BY 1""",
    "provisional_key": f"""
SELECT DISTINCT id, CASE WHEN p <> '' THEN 'mpn:' || p WHEN b <> '' AND m <> '' THEN 'bm:' || b || ':' || m ELSE '' END AS product_key
FROM (SELECT id, {_SQUEEZE.format("hint_mpn")} AS p, {_SQUEEZE.format("hint_brand")} AS b, {_SQUEEZE.format("hint_model")} AS m FROM offers)""",
    "land_acreage": f"""
WITH x AS (SELECT doc_id, nullif(regexp_extract(text, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*acres?\\b', 1), '') AS a, nullif(regexp_extract(text, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*ac\\b', 1), '') AS b,
  nullif(replace(regexp_extract(text, '(?i)([0-9][0-9,]*)\\s*(?:sq\\.?\\s*ft|sqft|square\\s+feet)\\b', 1), ',', ''), '') AS c FROM documents)
SELECT doc_id, coalesce({_float("a::double")}, {_float("b::double")}, {_float("floor(c::double / 43560.0 * 100 + 0.5) / 100")}) AS acreage FROM x WHERE coalesce(a, b, c) IS NOT NULL""",
    "land_flags": """
SELECT * FROM (SELECT doc_id,
  CASE WHEN regexp_matches(text, '(?i)\\bwell\\b') THEN 'true' ELSE '' END AS well,
  CASE WHEN regexp_matches(text, '(?i)\\bseptic\\b') THEN 'true' ELSE '' END AS septic,
  CASE WHEN regexp_matches(text, '(?i)\\b(fixer|teardown|tear-down|handyman|as-is|as is)\\b') THEN 'true' ELSE '' END AS fixer,
  CASE WHEN regexp_matches(text, '(?i)\\b(manufactured|mobile\\s+home|modular)\\b') THEN 'true' ELSE '' END AS manufactured,
  CASE WHEN regexp_matches(text, '(?i)\\b(owner|seller)\\s+financ') THEN 'true' ELSE '' END AS owner_financing,
  regexp_extract(text, '(?i)\\bAPN[:#]?\\s*([0-9][0-9\\-]{4,})', 1) AS apn FROM documents WHERE text IS NOT NULL)
WHERE well || septic || fixer || manufactured || owner_financing || apn <> ''""",
    "land_rows": f"""
WITH r AS (SELECT *, {_trim("zpid")} AS k, {_trim("coalesce(detailUrl, '')")} AS u, {_trim("addressCity")} AS c, {_trim("addressState")} AS s,
  lower({_trim("coalesce(lotArea.unit, '')")}) AS u1, lower({_trim("coalesce(hdpData.homeInfo.lotAreaUnit, '')")}) AS u2, lotArea.value AS v1, hdpData.homeInfo.lotAreaValue AS v2 FROM search_lots),
a AS (SELECT *, coalesce(
  CASE WHEN v1 > 0 THEN CASE WHEN u1 IN ('acres', 'acre', 'ac') THEN v1 WHEN u1 IN ('sqft', 'square feet', 'sq ft', 'sf', '') THEN v1 / 43560.0 END END,
  CASE WHEN v2 > 0 THEN CASE WHEN u2 IN ('acres', 'acre', 'ac') THEN v2 WHEN u2 IN ('sqft', 'square feet', 'sq ft', 'sf', '') THEN v2 / 43560.0 END END) AS acres FROM r WHERE k <> '')
SELECT k AS source_key, CASE WHEN u = '' OR u LIKE 'http://%' OR u LIKE 'https://%' THEN u WHEN u LIKE '/%' THEN 'https://lots.example' || u ELSE 'https://lots.example/' || u END AS source_url,
  coalesce({_trim("address")}, '') AS title, CASE WHEN unformattedPrice > 0 THEN floor(unformattedPrice * 100 + 0.5)::bigint ELSE 0 END AS price_cents, fetched_at AS seen_at,
  CASE WHEN c <> '' THEN CASE WHEN s <> '' THEN c || ', ' || s ELSE c END END AS location, nullif({_trim("addressZipcode")}, '') AS zip,
  CASE WHEN taxAssessedValue > 0 THEN floor(taxAssessedValue * 100 + 0.5)::bigint::varchar END AS assessed_value_cents, CASE WHEN daysOnZillow >= 0 THEN daysOnZillow::varchar END AS days_on_market,
  floor(acres * 1000 + 0.5)::bigint AS milliacres FROM a""",
    "storefront_variants": f"""
WITH {_TAGS},
v AS (SELECT source_id, id, handle, title, price_kind, tags, fetched_at, unnest(variants) AS vr FROM tagged
  WHERE lower(price_kind) LIKE 'hard drives%' OR lower(price_kind) LIKE 'hdds%'),
c AS (SELECT *, {_capacity("vr.title")} AS c1, {_capacity("vr.option1")} AS c2,
  (list_filter(list_transform(tags, lambda t: CASE WHEN regexp_extract(t, '(?i)^capacity:\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(TB|GB)$', 1) <> '' THEN
     regexp_extract(t, '(?i)^capacity:\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(TB|GB)$', 1)::double / CASE WHEN upper(regexp_extract(t, '(?i)^capacity:\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(TB|GB)$', 2)) = 'GB' THEN 1000.0 ELSE 1.0 END END), lambda x: x > 0))[1] AS c3,
  nullif(regexp_extract(price_kind, '(?i)>\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(TB|GB)\\s*>', 1), '')::double / CASE WHEN upper(regexp_extract(price_kind, '(?i)>\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(TB|GB)\\s*>', 2)) = 'GB' THEN 1000.0 ELSE 1.0 END AS c4,
  list_transform(tags, lambda t: lower(t)) AS low, {_trim("vr.sku")} AS sku FROM v WHERE vr.available AND coalesce(vr.id, 0) <> 0 AND coalesce(id, 0) <> 0)
SELECT source_id, id || ':' || vr.id AS source_key, 'https://shop.example/products/' || coalesce(handle, '') AS source_url, coalesce(title, '') AS title,
  CASE WHEN regexp_full_match({_trim("vr.price")}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND {_trim("vr.price")}::double > 0 THEN floor({_trim("vr.price")}::double * 100 + 0.5)::bigint ELSE 0 END AS price_cents,
  CASE WHEN len(list_filter(low, lambda t: contains(t, 'refurbished') OR contains(t, 'recertified') OR contains(t, 'used'))) > 0 THEN
         CASE WHEN regexp_matches(list_filter(low, lambda t: contains(t, 'refurbished') OR contains(t, 'recertified') OR contains(t, 'used'))[1], 'refurbished|recertified') THEN 'Refurbished' ELSE 'Used' END
       WHEN len(list_filter(low, lambda t: contains(t, 'new'))) > 0 THEN 'New' ELSE '' END AS condition_raw,
  {_float("coalesce(CASE WHEN c1 > 0 THEN c1 END, CASE WHEN c2 > 0 THEN c2 END, c3, c4)")} AS capacity_tb,
  coalesce(list_filter(list_transform(list_filter(tags, lambda t: starts_with(lower(t), 'brand:')), lambda t: {_trim("substring(t, 7)")}), lambda x: x <> '')[1], '') AS hint_brand,
  coalesce({_trim("CASE WHEN upper(sku) LIKE '%\\_SR' ESCAPE '\\' OR upper(sku) LIKE '%\\_UG' ESCAPE '\\' THEN left(sku, length(sku) - 3) WHEN upper(sku) LIKE '%\\_P' ESCAPE '\\' THEN left(sku, length(sku) - 2) ELSE sku END")}, '') AS hint_mpn,
  fetched_at AS seen_at FROM c""",
    "valuation_feed": f"""
WITH {_TAGS},
v AS (SELECT title, array_to_string(tags, ' ') AS words, unnest(variants) AS vr FROM tagged),
f AS (SELECT coalesce(nullif(regexp_extract(vr.title, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*TB\\b', 1), ''), nullif(regexp_extract(title, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*TB\\b', 1), ''))::double AS tb,
  CASE WHEN regexp_full_match({_trim("vr.price")}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND {_trim("vr.price")}::double > 0 THEN floor({_trim("vr.price")}::double * 100 + 0.5)::bigint ELSE 0 END AS cents,
  lower(concat_ws(' ', title, words)) AS w FROM v WHERE vr.available),
g AS (SELECT CASE WHEN regexp_matches(w, 'refurb|recert') THEN 'refurb' WHEN regexp_matches(w, 'used|pull') THEN 'used' WHEN contains(w, 'new') THEN 'new' ELSE 'refurb' END AS condition,
  floor(tb * 10 + 0.5)::bigint AS bucket, floor(cents / tb + 0.5)::bigint AS per_tb FROM f WHERE tb > 0 AND cents > 0)
SELECT bucket, condition, floor(median(per_tb) + 0.5)::bigint AS reference, count(*) AS n FROM g GROUP BY ALL""",
    "html_strip": f"SELECT row_id, {_trim(f"regexp_replace(regexp_replace(body_html, '(?s)<[^>]*>', ' ', 'g'), '{_WS}+', ' ', 'g')")} AS plain FROM products",
    "seller_profile_join": """
WITH r AS (SELECT DISTINCT id, seller, title FROM offers), f AS (SELECT seller, count(*) AS listed FROM r WHERE seller IS NOT NULL GROUP BY 1)
SELECT id, title, coalesce(listed, 0) AS listed FROM r LEFT JOIN f USING (seller)""",
    "event_offers": """
WITH e AS (SELECT *, substring(sha256(event_type || chr(0) || user_id), 1, 16) AS id, CASE WHEN value > 0 THEN floor(value * 100 + 0.5)::bigint ELSE 0 END AS c FROM events)
SELECT id, arg_max(event_type, event_id) AS source_id, arg_max(c, event_id) AS price_cents, min(ts) AS first_seen, max(ts) AS last_seen, coalesce(min(nullif(c, 0)), 0) AS min_price_cents FROM e GROUP BY id""",
}
