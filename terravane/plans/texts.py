"""Queries of the event text pipeline.

Keyword lists are words of the test tables; they stand for hazard vocabulary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import text
from terravane.operators import candidates, groundtruth, web
from terravane.operators.candidates import (
    ArticlePoints,
    ClassPoints,
    DetailPoints,
    PhraseRule,
    RowPoints,
    RowReasons,
)
from terravane.plans.bindings import VERIFIED_EVENTS_SQL, verified_events
from terravane.plans.registry import query, tidy, tidy_sql
from terravane.session import spread

RULES = {
    "FLOOD": PhraseRule(("thst", "erth", "of the th"), ("rewh",)),
    "DROUGHT": PhraseRule(("onth", "in the er"), ("hehely",)),
    "CYCLONE": PhraseRule(("erst", "que la", "der sch")),
}
# Points out of a hundred: each kind of evidence counts half of the one before it, from the hazard's
# words (40 to 52) over the state (up to 24), district (12) and country (6) to named place and link (3
# each), which add up to 100.  A hazard word in the link alone counts half of one in the text.  A row
# with hazard, state and district in full needs no review.
POINTS = ClassPoints(base=40, per_word=4, most_extra=12, url=20)
STATES = {"ALPHA": ("thre", "anti"), "BETA": ("thon", "ering", "le de"), "GAMMA": ("und", "thed", "los")}
COUNTRIES = {"action_country": "HM", "actor_country": "HOM"}
ROW = RowPoints(per_state_hit=12, most_state=24, district=12, country=6, geo_name=3, url=3, cap=100, review_below=76)
LACKS = RowReasons(state="no state named", district="no district named", country="other country", url="no link")
# the same scale, with coverage instead of place name and link
DETAIL = DetailPoints(
    country=6, state=16, per_hit=4, most_hits=8, district=12, coordinate=3, hazard=40,
    mentions=((16, 4, "mentioned 16 times"), (4, 2, "mentioned 4 times")),
    articles=((8, 4, "8 articles"), (2, 2, "2 articles")),
    tone=(-3.0, 4, "bad news"),
    cap=100, review_below=76,
    home_reason="own country", state_reason="state named", district_reason="district named", keyword_reason="word ",
)
CODES = {"030": "FLOOD", "031": "DROUGHT"}


def raw_rows(t):
    """Documents in the shape of raw event rows."""
    d, key = spread(t.documents), F.col("doc_id")
    return d.select(
        key.alias("event_key"),
        F.concat(
            F.lit("202401"), F.lpad((key % 31 + 1).cast("string"), 2, "0"),
            F.when(key % 7 == 0, ".0").when(key % 11 == 0, "x").otherwise(""),
        ).alias("sql_date"),
        F.when(key % 3 == 0, "HM").otherwise("XX").alias("action_country"),
        F.when(key % 4 == 0, "HOM").alias("actor_country"),
        F.when(key % 5 != 0, F.col("lang")).otherwise(" ").alias("geo_name"),
        F.when(key % 6 != 0, F.col("n_chars") / 100).alias("latitude"),
        F.when(key % 8 != 0, F.col("n_chars") / 50).alias("longitude"),
        (F.col("n_chars") % 30).alias("mentions"),
        (F.col("n_chars") % 12).alias("articles"),
        ((F.col("n_chars") % 11) - 5).cast("double").alias("tone"),
        F.concat(F.lit("03"), key % 5).alias("event_code"),
        F.when(key % 9 != 0, F.concat(F.lit("https://"), "source", F.lit(".org/erst-"), F.floor(key / 2))).alias("source_url"),
        F.col("text").alias("body"),
        text.normalise_text("text").alias("searchable"),
    )


RAW_SQL = """raw_rows AS (
  SELECT doc_id AS event_key, '202401' || lpad(CAST(doc_id % 31 + 1 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 7 = 0 THEN '.0' WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END AS sql_date,
    CASE WHEN doc_id % 3 = 0 THEN 'HM' ELSE 'XX' END AS action_country, CASE WHEN doc_id % 4 = 0 THEN 'HOM' END AS actor_country,
    CASE WHEN doc_id % 5 <> 0 THEN lang ELSE ' ' END AS geo_name, CASE WHEN doc_id % 6 <> 0 THEN n_chars / 100.0 END AS latitude,
    CASE WHEN doc_id % 8 <> 0 THEN n_chars / 50.0 END AS longitude, n_chars % 30 AS mentions, n_chars % 12 AS articles,
    (n_chars % 11) - 5 AS tone, '03' || (doc_id % 5) AS event_code,
    CASE WHEN doc_id % 9 <> 0 THEN 'https://' || source || '.org/erst-' || (doc_id // 2) END AS source_url, text AS body,
    trim(regexp_replace(regexp_replace(lower(text), 'https?://', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS searchable,
    trim(regexp_replace(regexp_replace(lower(coalesce(CASE WHEN doc_id % 9 <> 0 THEN 'https://' || source || '.org/erst-' || (doc_id // 2) END, '')), 'https?://', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS url_text
  FROM documents)"""


def has_sql(phrase: str, column: str = "searchable") -> str:
    return f"contains(' ' || {column} || ' ', ' {phrase} ')"


def any_sql(phrases, column: str = "searchable") -> str:
    return "(" + (" OR ".join(has_sql(p, column) for p in phrases) or "false") + ")"


def hits_sql(phrases, column: str = "searchable") -> str:
    return "(" + " + ".join(f"CAST({has_sql(p, column)} AS INTEGER)" for p in phrases) + ")"


ALIASES = [p for aliases in STATES.values() for p in aliases]


@query(
    "text_normalisation",
    "F12 F13",
    f"""WITH {RAW_SQL} SELECT event_key, md5(searchable) AS digest, {hits_sql(['the', 'of the', 'que la'])} AS phrases FROM raw_rows""",
)
def text_normalisation(t):
    r = raw_rows(t)
    joined = text.searchable("searchable", F.lit(None).cast("string"))
    return r.select(
        "event_key", F.md5(joined).alias("digest"), text.phrase_hits("searchable", ["the", "of the", "que la"], bounded=True).alias("phrases")
    )


@query(
    "region_filter",
    "P14",
    f"""WITH {RAW_SQL} SELECT event_key FROM raw_rows WHERE (action_country = 'HM' OR coalesce(actor_country, '') = 'HOM') AND {any_sql(ALIASES)}""",
)
def region_filter(t):
    return raw_rows(t).where(candidates.in_region(COUNTRIES, F.col("searchable"), ALIASES)).select("event_key")


@query(
    "like_any_filter",
    "P15",
    """SELECT doc_id FROM documents WHERE lower(text) LIKE '%erthth%' OR lower(text) LIKE '%queque%' OR lower(source) LIKE '%src7%'""",
)
def like_any_filter(t):
    test = candidates.contains_any_sql_like(["text", "source"], ["erthth", "queque", "SRC7"])
    return t.documents.where(test).select("doc_id")


def classified(t):
    r = raw_rows(t).withColumn("url_text", text.normalise_text("source_url"))
    included = [p for rule in RULES.values() for p in rule.include]
    excluded = [p for rule in RULES.values() for p in rule.exclude]
    body = text.Flags("searchable", included + excluded + ALIASES)
    link = text.Flags("url_text", included)
    flagged = link.attach(body.attach(r))
    return flagged.withColumns(candidates.classify(body, link, RULES, POINTS)).withColumns(
        candidates.infer_state(body, STATES)
    ).drop(body.name, link.name)


def _longest_sql(rule: PhraseRule) -> str:
    words = ", ".join(f"CASE WHEN {has_sql(p)} THEN {len(p.split())} ELSE 0 END" for p in rule.include)
    return f"CASE WHEN {any_sql(rule.exclude)} THEN 0 ELSE greatest({words}) END"


def _keyword_sql(rule: PhraseRule) -> str:
    return "CASE " + " ".join(f"WHEN {has_sql(p)} THEN '{p}'" for p in sorted(rule.include, key=lambda p: -len(p))) + " END"


def _points_sql(name: str) -> str:
    return f"CASE WHEN {name}_w > 0 THEN {POINTS.base} + least({name}_w * {POINTS.per_word}, {POINTS.most_extra}) ELSE 0 END"


_STATE_HITS = {s: hits_sql(a) for s, a in STATES.items()}
CLASSIFIED_SQL = f"""{RAW_SQL}, words AS (SELECT *, {', '.join(f'{_longest_sql(r)} AS {n}_w, {_keyword_sql(r)} AS {n}_k' for n, r in RULES.items())},
  {', '.join(f'{h} AS {s}_h' for s, h in _STATE_HITS.items())} FROM raw_rows),
pts AS (SELECT *, greatest({', '.join(_points_sql(n) for n in RULES)}) AS best, greatest(ALPHA_h, BETA_h, GAMMA_h) AS state_hits FROM words),
classified AS (SELECT *,
  CASE WHEN best > 0 THEN CASE {' '.join(f"WHEN {_points_sql(n)} = best THEN '{n}'" for n in RULES)} END
    ELSE CASE {' '.join(f"WHEN {any_sql(r.include, 'url_text')} THEN '{n}'" for n, r in RULES.items())} END END AS hazard,
  CASE WHEN best > 0 THEN CASE {' '.join(f"WHEN {_points_sql(n)} = best THEN {n}_k" for n in RULES)} END
    ELSE CASE {' '.join(f"WHEN {has_sql(p, 'url_text')} THEN '{p}'" for r in RULES.values() for p in r.include)} END END AS keyword,
  CASE WHEN best > 0 THEN best WHEN {any_sql([p for r in RULES.values() for p in r.include], 'url_text')} THEN {POINTS.url} ELSE 0 END AS hazard_points,
  concat_ws(';', CASE WHEN {has_sql('rewh')} THEN 'FLOOD: excluded phrase rewh' END, CASE WHEN {has_sql('hehely')} THEN 'DROUGHT: excluded phrase hehely' END) AS rejections,
  CASE WHEN state_hits = 0 THEN 'UNKNOWN' WHEN ALPHA_h = state_hits THEN 'ALPHA' WHEN BETA_h = state_hits THEN 'BETA' ELSE 'GAMMA' END AS state FROM pts)"""


@query(
    "rule_classification",
    "F16",
    f"WITH {CLASSIFIED_SQL} SELECT event_key, hazard, keyword, CAST(hazard_points AS INTEGER) AS hazard_points, rejections FROM classified",
)
def rule_classification(t):
    return classified(t).select(
        "event_key", "hazard", "keyword", "hazard_points", F.array_join("rejections", ";").alias("rejections")
    )


@query("state_inference", "F14", f"WITH {CLASSIFIED_SQL} SELECT event_key, state, state_hits FROM classified")
def state_inference(t):
    return classified(t).select("event_key", "state", "state_hits")


def place_names(t):
    """District names per state: every phrase of the benchmark texts, however long."""
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("item_id") % 3 + 1).cast("int"))
    phrases = F.filter(
        F.transform(F.split(F.lower("text"), r"[.,\n]+"), lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " "))),
        lambda p: p != "",
    )
    names = F.explode(phrases)
    return (
        t.benchmark.select(state.alias("state"), names.alias("district_norm"))
        .distinct()
        .withColumn("district", F.upper("district_norm"))
    )


PLACES_SQL = """bench AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[.,\\n]+')) AS part FROM benchmark),
cut AS (SELECT item_id, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS district_norm FROM bench),
place_names AS (SELECT DISTINCT CASE item_id % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' ELSE 'GAMMA' END AS state, district_norm FROM cut
  WHERE district_norm <> '')"""


def placed(t):
    return candidates.infer_district(classified(t), place_names(t), "event_key", "searchable")


PLACED_SQL = f"""{CLASSIFIED_SQL}, {PLACES_SQL}, found AS (
  SELECT event_key, district_norm FROM classified c JOIN place_names p ON p.state = c.state AND contains(' ' || searchable || ' ', ' ' || district_norm || ' ')
  QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY length(district_norm) DESC, district_norm) = 1),
placed AS (SELECT c.*, coalesce(upper(district_norm), 'UNKNOWN') AS district FROM classified c LEFT JOIN found USING (event_key))"""


@query("district_inference", "F15", f"WITH {PLACED_SQL} SELECT event_key, state, district FROM placed")
def district_inference(t):
    return placed(t).select("event_key", "state", "district")


SCORED_SQL = f"""{PLACED_SQL}, s AS (SELECT *, CAST(least(hazard_points + CASE WHEN state <> 'UNKNOWN' THEN least(state_hits * {ROW.per_state_hit}, {ROW.most_state}) ELSE 0 END + CASE WHEN district <> 'UNKNOWN' THEN {ROW.district} ELSE 0 END
    + CASE WHEN action_country = 'HM' THEN {ROW.country} ELSE 0 END + CASE WHEN trim(geo_name) <> '' THEN {ROW.geo_name} ELSE 0 END + CASE WHEN source_url IS NOT NULL THEN {ROW.url} ELSE 0 END, {ROW.cap}) AS INTEGER) AS score
  FROM placed WHERE hazard IS NOT NULL)"""


@query(
    "candidate_scores",
    "F19",
    f"""WITH {SCORED_SQL} SELECT event_key, score, CAST(score < {ROW.review_below} OR district = 'UNKNOWN' AS INTEGER) AS needs_review,
      concat_ws(';', CASE WHEN state = 'UNKNOWN' THEN '{LACKS.state}' END, CASE WHEN district = 'UNKNOWN' THEN '{LACKS.district}' END, CASE WHEN action_country <> 'HM' THEN '{LACKS.country}' END,
        CASE WHEN source_url IS NULL THEN '{LACKS.url}' END, CASE WHEN rejections <> '' THEN rejections END) AS review_reason FROM s WHERE score >= 45""",
)
def candidate_scores(t):
    rows = placed(t).where("hazard IS NOT NULL")
    scored = rows.withColumns(
        candidates.score_row(F.col("action_country") == "HM", F.col("geo_name"), F.col("source_url"), ROW, LACKS)
    )
    return scored.where("score >= 45").select(
        "event_key", F.col("score").cast("int").alias("score"), F.col("needs_review").cast("int").alias("needs_review"), "review_reason"
    )


HAZARD_WORDS = {n: r.include for n, r in RULES.items()}


def detailed(t):
    rows = placed(t).drop("hazard", "keyword")
    words = text.Flags("searchable", [p for ps in HAZARD_WORDS.values() for p in ps], bounded=False)
    rows = words.attach(rows).withColumns(
        candidates.hazard_from_text_or_code(words, "event_code", HAZARD_WORDS, CODES)
    )
    rows = rows.where("hazard IS NOT NULL")
    return rows.withColumns(
        candidates.score_detail(
            F.col("action_country") == "HM", F.col("latitude"), F.col("longitude"),
            F.col("mentions"), F.col("articles"), F.col("tone"), DETAIL,
        )
    )


_FIRST_HAZARD = "CASE " + " ".join(f"WHEN contains(searchable, '{p}') THEN '{n}'" for n, ps in HAZARD_WORDS.items() for p in ps) + " WHEN event_code = '030' THEN 'FLOOD' WHEN event_code = '031' THEN 'DROUGHT' END"
_FIRST_WORD = "CASE " + " ".join(f"WHEN contains(searchable, '{p}') THEN '{p}'" for ps in HAZARD_WORDS.values() for p in ps) + " WHEN event_code IN ('030', '031') THEN 'event_code:' || event_code END"
DETAILED_SQL = f"""{PLACED_SQL}, h AS (SELECT * EXCLUDE (hazard, keyword), {_FIRST_HAZARD} AS hazard, {_FIRST_WORD} AS keyword FROM placed),
detailed AS (SELECT *, CAST(least(CASE WHEN action_country = 'HM' THEN {DETAIL.country} ELSE 0 END + CASE WHEN state <> 'UNKNOWN' THEN {DETAIL.state} ELSE 0 END + least(state_hits * {DETAIL.per_hit}, {DETAIL.most_hits})
    + CASE WHEN district <> 'UNKNOWN' THEN {DETAIL.district} ELSE 0 END + CASE WHEN latitude IS NOT NULL THEN {DETAIL.coordinate} ELSE 0 END + CASE WHEN longitude IS NOT NULL THEN {DETAIL.coordinate} ELSE 0 END, {DETAIL.cap}) AS INTEGER) AS geography_points,
  CASE WHEN mentions >= 16 THEN 4 WHEN mentions >= 4 THEN 2 ELSE 0 END + CASE WHEN articles >= 8 THEN 4 WHEN articles >= 2 THEN 2 ELSE 0 END + CASE WHEN tone < -3 THEN 4 ELSE 0 END AS coverage_points
  FROM h WHERE hazard IS NOT NULL)"""


@query("hazard_from_code", "F17 F18 P17", f"WITH {DETAILED_SQL} SELECT event_key, hazard, keyword FROM detailed")
def hazard_from_code(t):
    return detailed(t).select("event_key", "hazard", "keyword")


@query(
    "detailed_candidate_scores",
    "F20",
    f"""WITH {DETAILED_SQL} SELECT event_key, geography_points, coverage_points, CAST(least(geography_points + {DETAIL.hazard} + coverage_points, {DETAIL.cap}) AS INTEGER) AS candidate_score,
      concat_ws(';', CASE WHEN action_country = 'HM' THEN '{DETAIL.home_reason}' END, CASE WHEN state <> 'UNKNOWN' THEN '{DETAIL.state_reason}' END, CASE WHEN district <> 'UNKNOWN' THEN '{DETAIL.district_reason}' END, '{DETAIL.keyword_reason}' || keyword,
        CASE WHEN mentions >= 16 THEN 'mentioned 16 times' WHEN mentions >= 4 THEN 'mentioned 4 times' END, CASE WHEN articles >= 8 THEN '8 articles' WHEN articles >= 2 THEN '2 articles' END,
        CASE WHEN tone < -3 THEN 'bad news' END) AS reasons,
      CAST(least(geography_points + {DETAIL.hazard} + coverage_points, {DETAIL.cap}) < {DETAIL.review_below} OR district = 'UNKNOWN' AS INTEGER) AS needs_review
    FROM detailed WHERE least(geography_points + {DETAIL.hazard} + coverage_points, {DETAIL.cap}) >= 50""",
)
def detailed_candidate_scores(t):
    return detailed(t).where("candidate_score >= 50").select(
        "event_key",
        "geography_points",
        "coverage_points",
        "candidate_score",
        "reasons",
        F.col("needs_review").cast("int").alias("needs_review"),
    )


@query(
    "candidate_ids_and_dates",
    "F21 F22",
    f"""WITH {RAW_SQL} SELECT event_key, 'CAND_' || substr(sha256(concat_ws('|', CAST(event_key AS VARCHAR), sql_date, geo_name, source_url)), 1, 16) AS candidate_id,
      CAST(CASE WHEN regexp_full_match(regexp_replace(sql_date, '[.]0+$', ''), '[0-9]{{8}}') THEN try_strptime(regexp_replace(sql_date, '[.]0+$', ''), '%Y%m%d')::DATE END AS VARCHAR) AS event_date FROM raw_rows""",
)
def candidate_ids_and_dates(t):
    return raw_rows(t).select(
        "event_key",
        text.stable_id("CAND_", "event_key", "sql_date", "geo_name", "source_url").alias("candidate_id"),
        text.compact_date("sql_date").cast("string").alias("event_date"),
    )


@query(
    "deduplicated_candidates",
    "K1 W14",
    f"""WITH {SCORED_SQL} SELECT event_key, source_url, score FROM s WHERE source_url IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_url, event_key // 2 ORDER BY score DESC, event_key) = 1""",
)
def deduplicated_candidates(t):
    rows = placed(t).where("hazard IS NOT NULL AND source_url IS NOT NULL")
    scored = rows.withColumns(
        candidates.score_row(F.col("action_country") == "HM", F.col("geo_name"), F.col("source_url"), ROW, LACKS)
    )
    grouped = scored.withColumn("id", F.col("event_key")).withColumn("event_key", F.floor(F.col("event_key") / 2))
    kept = candidates.deduplicated(grouped, [F.desc("score"), F.col("id")])
    return kept.select(F.col("id").alias("event_key"), "source_url", F.col("score").cast("int").alias("score"))


# severity grades halve the score from step to step; an unsure row counts half
BANDS = ((64, "GRADE 4"), (32, "GRADE 3"), (16, "GRADE 2"))


@query(
    "severity_and_confidence",
    "F23",
    f"""WITH {SCORED_SQL} SELECT event_key, CASE WHEN score >= 64 THEN 'GRADE 4' WHEN score >= 32 THEN 'GRADE 3' WHEN score >= 16 THEN 'GRADE 2' ELSE 'GRADE 1' END AS severity,
      {tidy_sql("least(CASE WHEN score < 76 OR district = 'UNKNOWN' THEN score * 0.5 ELSE score END, 100)", 2)} AS confidence FROM s""",
)
def severity_and_confidence(t):
    rows = placed(t).where("hazard IS NOT NULL")
    scored = rows.withColumns(
        candidates.score_row(F.col("action_country") == "HM", F.col("geo_name"), F.col("source_url"), ROW, LACKS)
    )
    out = scored.withColumns(groundtruth.severity_and_confidence("score", F.col("needs_review"), BANDS, "GRADE 1", 0.5))
    return out.select("event_key", "severity", tidy("confidence", 2).alias("confidence"))


PLACE_WORDS = ["thand", "ofthe", "erand", "inthe"]
# points and lengths of articles are powers of two: each band is four times as long as the next and
# earns twice its points, a body earns twice a headline, a keyword twice a place
ARTICLE = ArticlePoints(
    length=((8192, 32), (2048, 16), (512, 8)), per_keyword=4, most_keywords=32, headline=16, body=32,
    per_found=4, most_found=32, per_place=2, most_places=16, hazard_per_keyword=16, place_per_place=8,
    relevance={"title": 8, "long": 8, "keyword": 32, "place": 16, "impact": 32}, relevant_length=1024, weights=(0.5, 0.25, 0.25),
)
ARTICLE_WORDS = {"FLOOD": ["thst", "erth", "erthth"], "DROUGHT": ["onth", "ontion"], "CYCLONE": ["erst", "que la"]}
ALL_ARTICLE_WORDS = sorted({p for ps in ARTICLE_WORDS.values() for p in ps})


def analysed(t):
    d = spread(t.documents).select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"))
    return groundtruth.article_analysis(d, "text", ARTICLE_WORDS, PLACE_WORDS)


def _sub(words):
    return " + ".join(f"CAST(contains(low, '{p}') AS INTEGER)" for p in words)


ANALYSED_SQL = f"""a AS (SELECT doc_id, text, lower(text) AS low, CASE WHEN doc_id % 4 <> 0 THEN source END AS title FROM documents),
b AS (SELECT *, {_sub(ALL_ARTICLE_WORDS)} AS nk, {_sub(PLACE_WORDS)} AS np, {', '.join(f'{_sub(ps)} AS {n}_n' for n, ps in ARTICLE_WORDS.items())} FROM a)"""


@query(
    "article_keywords",
    "F24 F25",
    f"""WITH {ANALYSED_SQL} SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN contains(low, '{p}') THEN '{p}' END" for p in ALL_ARTICLE_WORDS)}) AS keywords,
      CASE {' '.join(f"WHEN contains(low, '{p}') THEN '{p}'" for ps in ARTICLE_WORDS.values() for p in ps)} END AS matched_keyword,
      CASE WHEN greatest(FLOOD_n, DROUGHT_n, CYCLONE_n) = 0 THEN NULL WHEN FLOOD_n >= greatest(DROUGHT_n, CYCLONE_n) THEN 'FLOOD' WHEN DROUGHT_n >= CYCLONE_n THEN 'DROUGHT' ELSE 'CYCLONE' END AS article_hazard,
      concat_ws(',', {', '.join(f"CASE WHEN contains(low, '{p}') THEN '{p}' END" for p in sorted(PLACE_WORDS))}) AS mentions FROM b""",
)
def article_keywords(t):
    return analysed(t).select(
        "doc_id",
        F.array_join("keywords", ",").alias("keywords"),
        "matched_keyword",
        "article_hazard",
        F.array_join("mentions", ",").alias("mentions"),
    )


@query(
    "article_scores",
    "F26",
    f"""WITH {ANALYSED_SQL}, c AS (SELECT *, CAST(least(CASE WHEN length(text) > 8192 THEN 32 WHEN length(text) > 2048 THEN 16 WHEN length(text) > 512 THEN 8 ELSE 0 END + least(nk * 4, 32), 100) AS INTEGER) AS article_quality,
      CAST(least(CASE WHEN length(title) > 0 THEN 16 ELSE 0 END + CASE WHEN length(text) > 0 THEN 32 ELSE 0 END + least(nk * 4, 32) + least(np * 2, 16), 100) AS INTEGER) AS enrichment_confidence,
      CAST(least(CASE WHEN length(title) > 0 THEN 8 ELSE 0 END + CASE WHEN length(text) > 1024 THEN 8 ELSE 0 END + CASE WHEN nk > 0 THEN 32 ELSE 0 END + CASE WHEN np > 0 THEN 16 ELSE 0 END
        + CASE WHEN contains(low, 'rest') OR contains(low, 'queux') THEN 32 ELSE 0 END, 100) AS INTEGER) AS relevance_score FROM b)
    SELECT doc_id, article_quality, enrichment_confidence, relevance_score,
      CAST((least(nk * 16, 100) * 2 + least(np * 8, 100) + relevance_score) // 4 AS INTEGER) AS article_score FROM c""",
)
def article_scores(t):
    out = analysed(t).withColumns(
        candidates.article_scores(F.col("title"), F.col("text"), F.col("keywords"), F.col("mentions"), ["rest", "queux"], ARTICLE)
    )
    return out.select("doc_id", "article_quality", "enrichment_confidence", "relevance_score", "article_score")


@query(
    "valid_news_rows",
    "P16",
    """SELECT doc_id FROM (SELECT doc_id, lower(text) AS low, CASE doc_id % 3 WHEN 0 THEN 'FLOOD' WHEN 1 THEN 'DROUGHT' ELSE 'STORM' END AS kind FROM documents)
    WHERE (contains(low, 'nder') OR contains(low, 'thor')) AND NOT contains(low, 'hehely') AND NOT contains(low, 'rewhth')
      AND ((kind = 'FLOOD' AND (contains(low, 'thst') OR contains(low, 'erth'))) OR (kind = 'DROUGHT' AND contains(low, 'onth')))""",
)
def valid_news_rows(t):
    kinds = F.array(F.lit("FLOOD"), F.lit("DROUGHT"), F.lit("STORM"))
    rows = t.documents.select(
        "doc_id",
        F.lower("text").alias("low"),
        F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"),
        F.lit("Nder of Thor").alias("state"),
    )
    test = candidates.valid_news(
        F.col("low"), F.col("state"), F.col("kind"), ["hehely"], ["rewhth"], {"FLOOD": ["thst", "erth"], "DROUGHT": ["onth"]}
    )
    return rows.where(test).select("doc_id")


@query(
    "keep_minus_drop_score",
    "P17",
    """SELECT doc_id, k - d AS verification_score FROM (SELECT doc_id, CAST(contains(low, 'thst') AS INTEGER) + CAST(contains(low, 'erth') AS INTEGER) + CAST(contains(low, 'queau') AS INTEGER) AS k,
      CAST(contains(low, 'onth') AS INTEGER) + CAST(contains(low, 'ering') AS INTEGER) AS d FROM (SELECT doc_id, lower(text) AS low FROM documents)) WHERE k > d""",
)
def keep_minus_drop_score(t):
    low = F.lower("text")
    score = candidates.keep_minus_drop(low, ["thst", "erth", "queau"], ["onth", "ering"])
    return t.documents.select("doc_id", score.alias("verification_score")).where("verification_score > 0")


@query(
    "enriched_candidates",
    "J17",
    """WITH e AS (SELECT doc_id // 3 AS id, n_chars, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY n_chars DESC, doc_id) = 1)
    SELECT c.doc_id AS id, c.quality, e.n_chars FROM labels c LEFT JOIN e ON e.id = c.doc_id""",
)
def enriched_candidates(t):
    enrichment = t.documents.select(F.floor(F.col("doc_id") / 3).alias("id"), "n_chars", "doc_id")
    base = t.labels.select(F.col("doc_id").alias("id"), "quality")
    return candidates.enrich(base, enrichment, "id", [F.desc("n_chars"), F.col("doc_id")]).select("id", "quality", "n_chars")


@query(
    "districts_named_in_text",
    "J21",
    """WITH parts AS (SELECT 'zone' || (item_id % 2) AS state, unnest(regexp_split_to_array(lower(text), '[.,\\n]+')) AS name FROM benchmark),
    n AS (SELECT DISTINCT state, trim(name) AS name FROM parts WHERE trim(name) <> '' UNION SELECT 'zone' || (item_id % 2), split_part(lower(text), ' ', 1) FROM benchmark),
    d AS (SELECT doc_id, 'zone' || (doc_id % 2) AS state, lower(text) AS low FROM documents),
    m AS (SELECT doc_id, name FROM d JOIN n ON n.state = d.state AND contains(low, name))
    SELECT DISTINCT doc_id, state, coalesce('in ' || name, 'UNKNOWN') AS district, CASE WHEN name IS NULL THEN 'none' ELSE 'district_name' END AS match_method FROM d LEFT JOIN m USING (doc_id)""",
)
def districts_named_in_text(t):
    # every phrase of the benchmark texts stands for a name, and each text's first word, however short
    zone, low = F.concat(F.lit("zone"), F.col("item_id") % 2).alias("state"), F.lower("text")
    phrases = F.transform(F.split(low, r"[.,\n]+"), lambda p: F.trim(p))
    words = F.array_append(phrases, F.substring_index(low, " ", 1))
    names = t.benchmark.select(zone, F.explode(words).alias("district_name")).where("district_name <> ''").distinct()
    names = names.withColumn("district", F.concat(F.lit("in "), "district_name"))
    texts = spread(t.documents).select(
        "doc_id", F.concat(F.lit("zone"), F.col("doc_id") % 2).alias("state"), F.lower("text").alias("body")
    )
    return candidates.districts_named(texts, names, "doc_id", "body")


def _truth_and_reports(t):
    truth = t.events.where("event_type IN ('error', 'purchase')").select(
        F.col("event_id").alias("truth_id"),
        F.to_date("ts").alias("date"),
        F.concat(F.lit("Zone "), F.col("user_id") % 40).alias("state"),
        F.concat(F.lit("Station "), F.col("user_id")).alias("district"),
    )
    reports = t.events.where("event_type NOT IN ('error', 'purchase')").select(
        F.col("event_id").alias("report_id"),
        F.to_date("ts").alias("date"),
        F.concat(F.lit("station "), F.col("user_id"), F.lit(" in zone "), F.col("user_id") % 60).alias("location"),
    )
    return truth, reports


_TRUTH_SQL = """truth AS (SELECT event_id AS truth_id, CAST(ts AS DATE) AS date, 'zone ' || (user_id % 40) AS state, 'station ' || user_id AS district FROM events WHERE event_type IN ('error', 'purchase')),
reports AS (SELECT event_id AS report_id, CAST(ts AS DATE) AS date, 'station ' || user_id || ' in zone ' || (user_id % 60) AS location FROM events WHERE event_type NOT IN ('error', 'purchase')),
pairs AS (SELECT truth_id, CASE WHEN contains(location, district) THEN 1 ELSE 2 END AS rk, r.date, report_id, location
  FROM truth t JOIN reports r ON abs(r.date - t.date) <= 2 AND (contains(location, district) OR contains(location, state))),
matches AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY truth_id ORDER BY rk, date, report_id) = 1)"""


@query(
    "detector_matches",
    "J20",
    f"WITH {_TRUTH_SQL} SELECT truth_id, CASE rk WHEN 1 THEN 'district' ELSE 'state' END AS match_level, report_id, CAST(date AS VARCHAR) AS report_date FROM matches",
)
def detector_matches(t):
    matches, _, _ = candidates.validate_detector(*_truth_and_reports(t), days=2)
    return matches.select("truth_id", "match_level", "report_id", F.col("report_date").cast("string").alias("report_date"))


@query(
    "detector_metrics",
    "J20",
    f"""WITH {_TRUTH_SQL}, n AS (SELECT (SELECT count(*) FROM matches) AS tp, (SELECT count(*) FROM reports WHERE location NOT IN (SELECT location FROM matches)) AS fp,
      (SELECT count(*) FROM truth WHERE truth_id NOT IN (SELECT truth_id FROM matches)) AS fn)
    SELECT tp, fp, fn, {tidy_sql('tp / (tp + fp)')} AS precision, {tidy_sql('tp / (tp + fn)')} AS recall,
      {tidy_sql('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))')} AS f1 FROM n""",
)
def detector_metrics(t):
    out = candidates.detector_metrics(*candidates.validate_detector(*_truth_and_reports(t), days=2))
    return out.select("tp", "fp", "fn", *[tidy(c).alias(c) for c in ("precision", "recall", "f1")])


def canonical(t):
    """Events as untyped records of two sources, coerced."""
    v = verified_events(t)
    first = v.where("hazard_type = 'flood'").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit(" "), "source").alias("source"),
        F.col("event_date").cast("string").alias("event_date"),
        "hazard_type",
        F.concat(F.lit("Zone "), F.col("user_id") % 5).alias("state"),
        "latitude",
        F.when(F.col("k") % 9 != 0, F.col("longitude")).alias("longitude"),
        F.when(F.col("k") % 2 == 0, "Yes").otherwise("no").alias("verified"),
        F.format_string("%.3f", "confidence").alias("confidence"),
        "source_event_id",
    )
    second = v.where("hazard_type = 'cyclone'").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("k") % 6 == 0, "bad").otherwise(F.date_format("event_date", "yyyy-MM-dd 00:00:00")).alias("event_date"),
        "hazard_type",
        F.concat(F.lit("Zone "), F.col("user_id") % 7).alias("state"),
        "latitude",
        "longitude",
        F.lit("1").alias("verified"),
        F.when(F.col("k") % 4 == 0, "n/a").otherwise(F.format_string("%.3f", "confidence")).alias("confidence"),
        F.col("source_event_id"),
        F.col("k").cast("string").alias("fatalities"),
    )
    merged = groundtruth.union_sources({"river": first, "storm": second, "absent": None})
    return groundtruth.coerced(
        merged,
        texts={"event_id": "", "source": "unknown", "source_event_id": "", "state": "", "district": "none", "hazard_type": ""},
        numbers=["latitude", "longitude", "confidence", "fatalities"],
        dates=["event_date"],
        flags=["verified"],
        upper=["hazard_type"],
        number_defaults={"confidence": 0.0},
    )


CANONICAL_SQL = f"""{VERIFIED_EVENTS_SQL}, canonical AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, source, event_date, 'FLOOD' AS hazard_type, 'Zone ' || (user_id % 5) AS state, latitude, CASE WHEN k % 9 <> 0 THEN longitude END AS longitude,
    k % 2 = 0 AS verified, {tidy_sql('confidence', 3)} AS confidence, source_event_id, NULL::DOUBLE AS fatalities, 'none' AS district, 'river' AS input_source FROM verified_events WHERE hazard_type = 'flood'
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'unknown', CASE WHEN k % 6 <> 0 THEN event_date END, 'CYCLONE', 'Zone ' || (user_id % 7), latitude, longitude, true,
    CASE WHEN k % 4 = 0 THEN 0 ELSE {tidy_sql('confidence', 3)} END, source_event_id, CAST(k AS DOUBLE), 'none', 'storm' FROM verified_events WHERE hazard_type = 'cyclone')"""


@query(
    "coerced_records",
    "P13 S7 U1",
    f"""WITH {CANONICAL_SQL} SELECT event_id, source, CAST(event_date AS VARCHAR) AS event_date, hazard_type, state, district, latitude, longitude, CAST(verified AS INTEGER) AS verified,
      {tidy_sql('confidence', 2)} AS confidence, fatalities, input_source FROM canonical""",
)
def coerced_records(t):
    return canonical(t).select(
        "event_id", "source", F.col("event_date").cast("string").alias("event_date"), "hazard_type", "state", "district",
        "latitude", "longitude", F.col("verified").cast("int").alias("verified"), tidy("confidence", 2).alias("confidence"), "fatalities", "input_source",
    )


REVIEW_KEYS = ["event_date", "hazard_type", "state", "district", "source_event_id"]


def decisions(t):
    """Reviewer decisions on some of the records."""
    c = canonical(t).where("event_date IS NOT NULL")
    number = F.col("event_id").cast("long")
    return c.where(number % 3 == 0).select(
        *REVIEW_KEYS,
        F.when(number % 9 == 0, " rejected").otherwise("approved").alias("review_status"),
        F.when(number % 12 == 0, "no").otherwise("yes").alias("event_occurred_in_district"),
        F.when(number % 15 == 0, "No").otherwise("yes").alias("date_correct"),
    )


REVIEWED_SQL = f"""{CANONICAL_SQL}, bad AS (SELECT DISTINCT event_date, hazard_type, state, source_event_id FROM canonical
    WHERE event_date IS NOT NULL AND event_id::BIGINT % 3 = 0 AND (event_id::BIGINT % 9 = 0 OR event_id::BIGINT % 12 = 0 OR event_id::BIGINT % 15 = 0)),
reviewed AS (SELECT c.* REPLACE (c.verified AND b.state IS NULL AS verified), b.state IS NOT NULL AS rejected FROM canonical c LEFT JOIN bad b ON b.event_date = c.event_date AND b.hazard_type = c.hazard_type AND b.state = c.state AND b.source_event_id = c.source_event_id),
judged AS (SELECT *, concat_ws(';', CASE WHEN NOT verified THEN 'not_verified' END, CASE WHEN state NOT IN ('Zone 0', 'Zone 1', 'Zone 2', 'Zone 3', 'Zone 4') THEN 'outside_states' END,
  CASE WHEN event_date IS NULL OR event_date < DATE '2024-01-03' THEN 'invalid_date' END, CASE WHEN longitude IS NULL OR latitude NOT BETWEEN -49 AND 60 THEN 'outside_region' END,
  CASE WHEN confidence < 45 THEN 'low_confidence' END) AS review_reason FROM reviewed)"""


def judged(t):
    reviewed = groundtruth.with_reviews(canonical(t), decisions(t), REVIEW_KEYS)
    return groundtruth.judged(
        reviewed,
        {
            "not_verified": F.col("verified"),
            "outside_states": F.col("state").isin(*[f"Zone {i}" for i in range(5)]),
            "invalid_date": F.col("event_date") >= F.lit("2024-01-03").cast("date"),
            "outside_region": F.col("longitude").isNotNull() & F.col("latitude").between(-49, 60),
            "low_confidence": F.col("confidence") >= 45,
        },
    )


@query("reviewer_overrides", "J18", f"WITH {REVIEWED_SQL} SELECT event_id, CAST(verified AS INTEGER) AS verified FROM reviewed")
def reviewer_overrides(t):
    out = groundtruth.with_reviews(canonical(t), decisions(t), REVIEW_KEYS)
    return out.select("event_id", F.col("verified").cast("int").alias("verified"))


@query(
    "accept_reject_reasons",
    "P11 P12 U4",
    f"WITH {REVIEWED_SQL} SELECT event_id, CAST(review_reason = '' AS INTEGER) AS accepted, review_reason FROM judged",
)
def accept_reject_reasons(t):
    return judged(t).select("event_id", F.col("accepted").cast("int").alias("accepted"), "review_reason")


CANON_KEYS = ["event_date", "hazard_type", "state", "latitude", "longitude"]


@query(
    "canonical_events",
    "W14 P11",
    f"""WITH {REVIEWED_SQL} SELECT CAST(event_date AS VARCHAR) AS event_date, hazard_type, state, latitude, longitude, max(event_id) AS event_id FROM judged WHERE review_reason = '' GROUP BY ALL""",
)
def canonical_events(t):
    accepted, _ = groundtruth.split(judged(t))
    kept = groundtruth.unique_events(accepted, CANON_KEYS, ["event_id"])
    return kept.select(F.col("event_date").cast("string").alias("event_date"), *CANON_KEYS[1:], "event_id")


@query(
    "retained_rejects",
    "J19 U5",
    f"""WITH {REVIEWED_SQL} SELECT event_id FROM canonical c SEMI JOIN bad b ON b.event_date = c.event_date AND b.hazard_type = c.hazard_type AND b.state = c.state AND b.source_event_id = c.source_event_id""",
)
def retained_rejects(t):
    bad = decisions(t).where(
        "trim(upper(review_status)) = 'REJECTED' OR upper(event_occurred_in_district) = 'NO' OR upper(date_correct) = 'NO'"
    )
    return groundtruth.retained_rejects(canonical(t), bad, REVIEW_KEYS).select("event_id")


@query(
    "record_validation",
    "F51",
    f"""WITH {CANONICAL_SQL} SELECT event_id, concat_ws(';', CASE WHEN hazard_type NOT IN ('FLOOD') THEN 'hazard_type_enum' END, CASE WHEN latitude < -49 OR latitude > 40 THEN 'latitude_range' END,
      CASE WHEN fatalities > 90 THEN 'fatalities_range' END, CASE WHEN confidence < 41 OR confidence > 100 THEN 'confidence_range' END) AS violations FROM canonical""",
)
def record_validation(t):
    found = groundtruth.record_violations(
        {"hazard_type": ["FLOOD"]},
        {"latitude": (-49, 40), "fatalities": (None, 90), "confidence": (41, 100)},
        ["state", "district"],
    )
    return canonical(t).select("event_id", F.array_join(found, ";").alias("violations"))


@query(
    "news_records",
    "F48",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'FLOOD' WHEN 'fr' THEN 'DROUGHT' END AS hazard_type, CASE WHEN doc_id % 2 = 0 THEN source ELSE text END AS description,
      CAST(lang IN ('en', 'fr') AS INTEGER) AS valid FROM documents""",
)
def news_records(t):
    articles = t.documents.select(
        "doc_id",
        F.concat(F.lit(" "), F.upper("lang")).alias("event_type"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("description"),
        F.col("text").alias("content"),
        F.lit("2024-01-05").alias("date"),
    )
    out = groundtruth.news_records(articles, {"en": "FLOOD", "fr": "DROUGHT"})
    return out.select("doc_id", "hazard_type", "description", F.col("valid").cast("int").alias("valid"))


@query(
    "alert_records",
    "F49",
    """WITH a AS (SELECT o_custkey AS alert_id, o_orderkey AS row_order, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS d, o_orderstatus = 'P' AS tmp,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'RED' WHEN '2-HIGH' THEN 'ORANGE' ELSE 'GREEN' END AS colour FROM orders)
    SELECT alert_id, CAST(d AS VARCHAR) AS event_date, colour AS alert_level, CASE colour WHEN 'RED' THEN 'SEVERE' WHEN 'ORANGE' THEN 'MODERATE' ELSE 'MINOR' END AS severity,
      'ALERT_' || alert_id || '_New_Zone_d' || alert_id AS event_id FROM a WHERE NOT tmp AND year(d) BETWEEN 1996 AND 1999 QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY row_order) = 1""",
)
def alert_records(t):
    alerts = t.orders.select(
        F.col("o_custkey").alias("alert_id"),
        F.col("o_orderkey").alias("row_order"),
        F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_date"),
        (F.col("o_orderstatus") == "P").alias("temporary"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Red").when(F.col("o_orderpriority") == "2-HIGH", "Orange").alias("colour"),
        F.lit("New Zone").alias("state"),
        F.concat(F.lit("d"), "o_custkey").alias("district"),
    )
    out = groundtruth.alert_records(alerts, 1996, 1999, {"RED": "SEVERE", "ORANGE": "MODERATE"}, "MINOR")
    return out.select("alert_id", F.col("event_date").cast("string").alias("event_date"), "alert_level", "severity", "event_id")


@query(
    "page_hashes",
    "F52",
    "SELECT page_id, sha256(html) AS document_id FROM pages",
)
def page_hashes(t):
    return t.pages.select("page_id", web.document_id("html").alias("document_id"))


_UNESCAPED = "regexp_replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"
_TAGLESS = "trim(regexp_replace(regexp_replace(regexp_replace({}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _dropped_sql(column: str) -> str:
    for tag in web.DROPPED:
        column = f"regexp_replace({column}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return column


@query(
    "page_fields",
    "F27",
    f"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) AS art FROM pages),
    b AS (SELECT page_id, list_filter(list_transform(string_split_regex(art, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda x: {_TAGLESS.format("regexp_replace(x, '(?is)</(?:p|article|body)\\s*>.*', '')")}), lambda y: length(y) >= 30) AS blocks FROM p)
    SELECT page_id, {_UNESCAPED.format(_TAGLESS.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))} AS title, NULL::VARCHAR AS description,
      md5({_UNESCAPED.format("array_to_string(blocks, chr(10) || chr(10))")}) AS article_digest, len(blocks) AS paragraphs,
      md5({_UNESCAPED.format(_TAGLESS.format(_dropped_sql('html')))}) AS clean_digest FROM p JOIN b USING (page_id)""",
)
def page_fields(t):
    fields = web.page_fields(spread(t.pages))
    return fields.select(
        "page_id",
        "title",
        "description",
        F.md5("article_text").alias("article_digest"),
        F.size(F.filter(F.split("article_text", "\n\n"), lambda p: p != "")).alias("paragraphs"),
        F.md5("clean_text").alias("clean_digest"),
    )


BULLETIN_STATES = web.BulletinStates(active="open", none="closed", linked="announced", nothing="silent")
LINK_PHRASES = ["/the", "/de", "/und", "/thanedble"]


@query(
    "page_bulletins",
    "F28",
    """WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', 1)) AS href,
      unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', 2)) AS label FROM pages),
    w AS (SELECT *, lower(label || ' ' || href) AS joined FROM m),
    s AS (SELECT page_id, count(DISTINCT href) AS n, bool_or(contains(lower(label), 'the') AND NOT contains(lower(href), '/then')) AS act, bool_or(contains(lower(href), '/then')) AS non
      FROM w WHERE contains(joined, '/the') OR contains(joined, '/de') OR contains(joined, '/und') OR contains(joined, '/thanedble') GROUP BY 1)
    SELECT page_id, coalesce(n, 0) AS bulletins, CASE WHEN act THEN 'open' WHEN non THEN 'closed' WHEN n > 0 THEN 'announced' ELSE 'silent' END AS status
    FROM (SELECT DISTINCT page_id FROM m) LEFT JOIN s USING (page_id)""",
)
def page_bulletins(t):
    return web.bulletin_status(web.links(t.pages, "page_id"), "page_id", LINK_PHRASES, "/then", "the", BULLETIN_STATES)
