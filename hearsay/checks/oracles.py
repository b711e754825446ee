"""The queries of ``queries.py`` as SQL for DuckDB.

Averages and shares are rounded in whole numbers here, so that a tie (x.xx5) is decided by
arithmetic and not by the last bit of a double.
"""

from __future__ import annotations

from hearsay.checks.queries import ALIKE, FIRST, LAST, LOAD_DAY, PAGE, POSTS_PER_DAY, SOME_SUBREDDITS
from hearsay.checks.stored import MOVED
from hearsay.checks.streams import CLOSING_DELAY_DAYS
from hearsay.functions.text import BOT_PATTERN, STRICT_BOT_PATTERN
from hearsay.scoring.lexicon import WORD_SEPARATOR, LexiconScorer
from hearsay.sources.sample_posts import language_scorers, prose_scorers, tone_of_documents
from hearsay.sources.tables import STAGED_COLUMNS

POSTS = r"""
base AS (
  SELECT e.event_id, e.user_id, e.event_type, e.value, e.props, e.ts, d.text, d.lang, d.source
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
),
once AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id,
    CASE user_id % 25 WHEN 0 THEN 'AutoModerator' WHEN 1 THEN '[deleted]'
      WHEN 2 THEN 'robot_' || user_id ELSE ' user_' || user_id || ' ' END AS author,
    ' ' || source AS subreddit,
    CASE WHEN event_id % 50 = 7 THEN 'wow' || repeat('!', 12)
      WHEN event_id % 97 = 3 THEN NULL
      ELSE split_part(text, chr(10), 1) END AS title,
    CASE WHEN event_id % 41 <> 5 THEN text END AS selftext,
    CAST(round(value * 1000) AS BIGINT) AS score,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS num_comments,
    ts AS created_at,
    CAST(floor(epoch(ts)) AS BIGINT) AS created_utc,
    'https://example.com/r/' || source || '/' || event_id AS url,
    CASE event_type WHEN 'error' THEN TRUE WHEN 'signup' THEN NULL ELSE FALSE END AS over_18,
    event_type AS link_flair_text, upper(lang) AS author_flair_text
  FROM base
),
bronze AS (
  SELECT * EXCLUDE (event_id), created_at + INTERVAL 1 DAY AS load_date FROM once
  UNION ALL
  SELECT * EXCLUDE (event_id) REPLACE (score + 1 AS score), created_at + INTERVAL 2 DAY
  FROM once WHERE event_id % 10 = 0
)"""

LABEL_NAMES = tuple(s.name for s in prose_scorers())

TRIMMED = ", ".join(
    f"trim({c}) AS {c}" for c in
    ("author", "subreddit", "title", "selftext", "url", "link_flair_text", "author_flair_text")
)

SILVER = POSTS + f""",
cleaned AS (
  SELECT * REPLACE ({TRIMMED}),
    coalesce(regexp_matches(lower(trim(author)), '{BOT_PATTERN}'), FALSE) AS is_bot
  FROM bronze
),
silver AS (
  SELECT * FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_date DESC, score DESC) = 1
)"""


def _listing(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


def _scored_columns(
    s: LexiconScorer, allowed: str | None = None
) -> tuple[list[str], list[str], list[str]]:
    """Counts, logits and results of one word-list scorer, one SQL column each. ``allowed`` is a
    condition on the label's number {i}; labels that fail it are out of the running."""
    n, size = s.name, len(s.labels)
    use = [f"CASE WHEN {allowed.format(i=i)} THEN " if allowed else "" for i in range(size)]
    counts = [
        f"{use[i]}len(list_filter(hits, lambda w: list_contains({_listing(words)}, w))){' ELSE 0 END' if allowed else ''} AS {n}_n{i}"
        for i, words in enumerate(s.words.values())
    ]
    matched = "greatest(" + " + ".join(f"{n}_n{i}" for i in range(size)) + ", 1)"
    logits = [
        f"{use[i]}{float(s.bias.get(label, 0.0))}::DOUBLE"
        f" + ({float(s.sharpness)}::DOUBLE * {n}_n{i}) / {matched}"
        f"{' ELSE -1e6::DOUBLE END' if allowed else ''} AS {n}_l{i}"
        for i, label in enumerate(s.labels)
    ]
    top = "greatest(" + ", ".join(f"{n}_l{i}" for i in range(size)) + ")"
    label = " ".join(
        f"WHEN {n}_l{i} = {top} THEN '{name}'" for i, name in enumerate(s.labels)
    )
    spread = " + ".join(f"exp({n}_l{i} - {top})" for i in range(size))
    results = [
        f"CASE WHEN is_blank THEN '{s.fallback}' {label} END AS {n}",
        f"CASE WHEN is_blank THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE / ({spread}), 6) END"
        f" AS {n}_confidence",
    ]
    return counts, logits, results


FIRST_COPIES = SILVER.replace("load_date DESC, score DESC", "load_date, score")


def _gold(silver: str = SILVER, columns=None, scorers=None, allowed: str | None = None) -> str:
    """``silver`` with labels: a table ``gold`` of ``columns`` and the scorers' results."""
    scorers = scorers or prose_scorers()
    columns = columns or [c for c in STAGED_COLUMNS if not c.startswith(LABEL_NAMES)]
    parts = [_scored_columns(s, allowed) for s in scorers]
    vocabulary = sorted({w for s in scorers for w in s.vocabulary})
    counts, logits, results = (
        ",\n    ".join(x for p in parts for x in p[i]) for i in range(3)
    )
    return silver + f""",
texts AS (
  SELECT *, coalesce(title, '') || ' ' || coalesce(selftext, '') AS txt FROM silver
),
words AS (
  SELECT *, NOT regexp_matches(txt, '\\S') AS is_blank,
    list_filter(string_split_regex(lower(txt), '{WORD_SEPARATOR}'),
      lambda w: list_contains({_listing(vocabulary)}, w)) AS hits
  FROM texts
),
counted AS (SELECT *, {counts} FROM words),
weighed AS (SELECT *, {logits} FROM counted),
gold AS (
  SELECT {", ".join(columns)},
    {results}
  FROM weighed
)"""


GOLD = _gold()
FIRST_GOLD = _gold(FIRST_COPIES)


def _avg(value: str, places: int) -> str:
    """Average of whole numbers (zero or more), rounded half up; NULLs do not count."""
    unit = 10 ** places
    return (
        f"CAST((sum({value}) * {2 * unit} + count({value})) // nullif(2 * count({value}), 0)"
        f" AS DOUBLE) / {unit}"
    )


def _avg_confidence(value: str) -> str:
    """Average of six-digit confidences, rounded half up to three digits."""
    micro = f"CAST(round({value} * 1000000) AS BIGINT)"
    return (
        f"CAST((2 * sum({micro}) + 1000 * count({value})) // (2000 * count({value}))"
        f" AS DOUBLE) / 1000"
    )


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"CAST(({part} * 20000 + {whole}) // (2 * {whole}) AS DOUBLE) / 100"


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _feelings(suffix: str) -> str:
    return ", ".join(
        _n(f"sentiment = '{s}'") + f" AS {s}_{suffix}" for s in ("positive", "negative", "neutral")
    )


def _sum(value: str) -> str:
    return f"CAST(coalesce(sum({value}), 0) AS BIGINT)"


CHAR_RUN = (
    "coalesce(len(list_filter(range(1, greatest(length(title) - 9, 1)), lambda i:"
    " substring(title, CAST(i AS BIGINT), 11)"
    " = repeat(substring(title, CAST(i AS BIGINT), 1), 11))) > 0, FALSE)"
)
SPECIAL = "coalesce(length(regexp_replace(title, '[^!@#$%^&*()]', '', 'g')) > 10, FALSE)"
HIGH = "coalesce(score > 100000, FALSE)"

DAYS = f"CAST(created_at AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
SUBS = "subreddit IN (" + ", ".join(f"'{s}'" for s in SOME_SUBREDDITS) + ")"

THE_DAY = f"""
  SELECT * FROM bronze
  WHERE coalesce(over_18, FALSE) = FALSE AND CAST(created_at AS DATE) = DATE '{LOAD_DAY}'
  ORDER BY score DESC, id LIMIT {POSTS_PER_DAY}"""

PAGE_COLUMNS = (
    "id, subreddit, author, title, score, num_comments, CAST(created_at AS DATE) AS post_date, url"
)

NULLS = ", ".join(
    _n(f"{c} IS NULL OR trim(CAST({c} AS VARCHAR)) = ''") + f" AS {c}"
    for c in ("id", "author", "title", "created_at", "score")
)
NULLS_TOTAL = "id + author + title + created_at + score AS total_nulls"
SPAMS = (
    f"{_n(CHAR_RUN)} AS char_spam, {_n(SPECIAL)} AS special_char_spam,"
    f" {_n(HIGH)} AS high_score_spam"
)
SPAM_TOTAL = "char_spam + special_char_spam + high_score_spam AS total_spam"
BOTS = (
    f"count(*) AS total_records, {_n('is_bot')} AS bot_records,"
    f" {_n('NOT is_bot')} AS regular_records, {_pct(_n('is_bot'))} AS bot_pct,"
    f" {_pct(_n('NOT is_bot'))} AS regular_pct"
)

SENTIMENT_MART = f"""
  SELECT subreddit, count(*) AS total_posts, {_feelings("count")},
    {", ".join(_pct(_n(f"sentiment = '{s}'")) + f" AS {s}_pct"
               for s in ("positive", "negative", "neutral"))},
    {_avg_confidence("sentiment_confidence")} AS avg_sentiment_confidence,
    {_avg("score", 2)} AS avg_score, max(score) AS max_score,
    {_sum("score")} AS total_score, {_avg("num_comments", 2)} AS avg_comments,
    max(num_comments) AS max_comments
  FROM gold WHERE subreddit IS NOT NULL GROUP BY subreddit"""

TOPIC_MART = f"""
  SELECT topic, count(*) AS post_count, {_feelings("posts")},
    {_avg_confidence("topic_confidence")} AS avg_topic_confidence,
    {_avg_confidence("sentiment_confidence")} AS avg_sentiment_confidence,
    {_avg("score", 2)} AS avg_score, max(score) AS top_score,
    {_avg("num_comments", 2)} AS avg_comments,
    array_to_string(list_sort(list(DISTINCT subreddit)), ',') AS related_subreddits
  FROM gold WHERE topic IS NOT NULL GROUP BY topic"""

EMOTION_MART = f"""
  SELECT emotion, count(*) AS post_count,
    {_pct("count(*)", "(SELECT count(*) FROM gold WHERE emotion IS NOT NULL)")} AS percentage,
    {_avg_confidence("emotion_confidence")} AS avg_confidence,
    round(min(emotion_confidence), 3) AS min_confidence,
    round(max(emotion_confidence), 3) AS max_confidence,
    {_feelings("sentiment_count")}, {_avg("score", 2)} AS avg_score,
    max(score) AS highest_score, {_avg("num_comments", 2)} AS avg_comments
  FROM gold WHERE emotion IS NOT NULL GROUP BY emotion"""

DAILY_MART = f"""
  SELECT CAST(created_at AS DATE) AS post_date, count(*) AS total_posts, {_feelings("posts")},
    {_avg("score", 2)} AS avg_score, max(score) AS top_score, {_sum("score")} AS total_score,
    {_avg("num_comments", 2)} AS avg_comments,
    count(DISTINCT subreddit) AS unique_subreddits, count(DISTINCT author) AS unique_authors,
    count(DISTINCT topic) AS unique_topics,
    {_avg_confidence("sentiment_confidence")} AS avg_sentiment_confidence,
    {_avg_confidence("emotion_confidence")} AS avg_emotion_confidence,
    {_avg_confidence("topic_confidence")} AS avg_topic_confidence
  FROM gold WHERE created_at IS NOT NULL GROUP BY 1"""

KPI = f"""
  SELECT count(*) AS total_posts, {_sum("score")} AS total_score, {_avg("score", 1)} AS avg_score,
    {_sum("num_comments")} AS total_comments, {_avg("num_comments", 1)} AS avg_comments,
    count(DISTINCT subreddit) AS unique_subreddits, count(DISTINCT author) AS unique_authors,
    CASE WHEN count(*) > 0 THEN CAST(sum(num_comments) AS DOUBLE) / count(*) ELSE 0.0 END
      AS engagement_rate
  FROM silver"""

TREND = f"""
  SELECT CAST(created_at AS DATE) AS date, count(*) AS posts, {_sum("score")} AS total_score,
    {_sum("num_comments")} AS comments
  FROM silver"""


def _labels(kind: str) -> str:
    return f"""
  SELECT {kind}, count(*) AS count, {_avg_confidence(f"{kind}_confidence")} AS avg_confidence
  FROM gold GROUP BY {kind}"""


def _spread(kind: str, where: str, limit: str = "") -> str:
    return f"""
  SELECT {kind}, count(*) AS count FROM gold WHERE {where}
  GROUP BY {kind} ORDER BY count DESC, {kind} {limit}"""


def _page(where: str = "TRUE", by: str = "created_at") -> str:
    return f"""
  SELECT {PAGE_COLUMNS} FROM silver WHERE {where}
  ORDER BY {by} DESC NULLS LAST, silver.id LIMIT {PAGE}"""


def _placed(by: str) -> str:
    return f"""
  SELECT *, row_number() OVER (ORDER BY {by} DESC NULLS LAST, id) AS place FROM ({_page()})"""


def _keys(kind: str) -> str:
    return f"""
  SELECT '{kind}_' || replace(replace({kind}, ' ', '_'), '&', 'and') || '_count' AS key,
    count(*) AS value
  FROM gold GROUP BY {kind}"""


TONE = """
tone AS (
  SELECT id, coalesce(title, '') || ' ' || coalesce(selftext, '') AS txt FROM silver
),
marks AS (
  SELECT id, txt, len(txt) - len(replace(txt, '.', '')) + 1.0::DOUBLE AS s,
    len(txt) - len(replace(txt, '?', '')) + 1.0::DOUBLE AS q,
    len(txt) - len(replace(txt, '!', '')) + 1.0::DOUBLE AS x
  FROM tone
)
SELECT id,
  CASE WHEN NOT regexp_matches(txt, '\\S') THEN 'statement'
    WHEN s >= q AND s >= x THEN 'statement' WHEN q >= x THEN 'question'
    ELSE 'exclamation' END AS tone,
  CASE WHEN NOT regexp_matches(txt, '\\S') THEN 0.0::DOUBLE
    ELSE round(greatest(s, q, x) / (s + q + x), 6) END AS tone_confidence,
  CAST(NULL AS VARCHAR) AS tone_error
FROM marks"""


TURNS = """
silver AS (SELECT conv_id, role, text AS title, CAST(NULL AS VARCHAR) AS selftext FROM conversations)"""

CONFUSION = _gold("""
silver AS (SELECT doc_id, text AS title, CAST(NULL AS VARCHAR) AS selftext FROM documents)""",
                  ["doc_id"], [tone_of_documents()]) + """,
matrix AS (
  SELECT CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END AS truth, verdict AS predicted,
    count(*) AS n
  FROM gold JOIN labels USING (doc_id) WHERE toxic IN (0, 1) GROUP BY 1, 2
)"""


MEMBERS = SILVER + """,
members AS (SELECT DISTINCT subreddit, author FROM silver WHERE subreddit IS NOT NULL AND author IS NOT NULL),
sizes AS (SELECT subreddit, count(*) AS n FROM members GROUP BY subreddit)"""
ALIKE_PAIRS = MEMBERS + f""",
edges AS (
  SELECT a, b, shared, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard
  FROM (SELECT p.subreddit AS a, q.subreddit AS b, count(*) AS shared
        FROM members p JOIN members q ON p.author = q.author AND p.subreddit < q.subreddit GROUP BY 1, 2)
  JOIN sizes x ON x.subreddit = a JOIN sizes y ON y.subreddit = b
  WHERE shared * {ALIKE.denominator} >= (x.n + y.n - shared) * {ALIKE.numerator}
)"""
GRAPH = "RECURSIVE " + ALIKE_PAIRS.strip() + """,
ways AS (SELECT a AS node, b AS other, shared, jaccard FROM edges UNION ALL SELECT b, a, shared, jaccard FROM edges),
reached(node, other) AS (
  SELECT subreddit, subreddit FROM sizes UNION SELECT r.node, w.other FROM reached r JOIN ways w ON w.node = r.other
),
around AS (SELECT node, count(*) AS neighbours, CAST(sum(shared) AS BIGINT) AS shared FROM ways GROUP BY node),
strongest AS (SELECT node, other FROM ways QUALIFY row_number() OVER (PARTITION BY node ORDER BY jaccard DESC, other) = 1)"""

MARKED = r"""
marked AS (
  SELECT doc_id, text, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS truth
  FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1) AND length(text) % 5 <> 0
),
seen AS (
  SELECT DISTINCT doc_id, truth, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM marked
),
everywhere AS (SELECT word, count(*) AS n FROM seen WHERE word <> '' GROUP BY word HAVING count(*) >= 2),
per AS (SELECT word, truth, count(*) AS n FROM seen GROUP BY word, truth),
texts AS (SELECT truth AS label, count(*) AS n FROM marked GROUP BY truth),
learned AS (
  SELECT e.word, t.label, round(ln(((coalesce(p.n, 0) + 0.5::DOUBLE) / (t.n + 1.0::DOUBLE))
    / ((e.n + 0.5::DOUBLE) / ((SELECT count(*) FROM marked) + 1.0::DOUBLE))), 6) AS weight
  FROM everywhere e CROSS JOIN texts t LEFT JOIN per p ON p.word = e.word AND p.truth = t.label
)"""
WORD_VERDICTS = MARKED + r""",
all_words AS (
  SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents
),
logits AS (
  SELECT doc_id, CAST(sum(CASE label WHEN 'clean' THEN CAST(weight AS DECIMAL(18,6)) END) AS DOUBLE) AS clean,
    CAST(sum(CASE label WHEN 'toxic' THEN CAST(weight AS DECIMAL(18,6)) END) AS DOUBLE) AS toxic
  FROM all_words JOIN learned USING (word) GROUP BY doc_id
),
every AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(clean, 0.0) AS clean, coalesce(toxic, 0.0) AS toxic
  FROM documents LEFT JOIN logits USING (doc_id)
)"""


def _language_parts() -> list[str]:
    """A SELECT per language with its own word lists."""
    scorers, other = language_scorers()
    tests = {f"lang = '{lang}'": s for lang, s in scorers.items()}
    listed = ", ".join(f"'{lang}'" for lang in scorers)
    tests[f"lang NOT IN ({listed}) OR lang IS NULL"] = other
    silver = """
silver AS (SELECT lang, text AS title, CAST(NULL AS VARCHAR) AS selftext FROM documents WHERE {})"""
    return [f"(WITH {_gold(silver.format(test), ['lang'], [s])} SELECT * FROM gold)"
            for test, s in tests.items()]


def _after(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def _bodies() -> dict[str, tuple[str, str]]:
    """Query name to (common table expressions, final SELECT)."""
    bronze, silver, gold = POSTS, SILVER, GOLD
    confident = (
        "SELECT id, title, sentiment, sentiment_confidence, score FROM gold"
        " WHERE sentiment = 'negative' AND sentiment_confidence > 0.8"
        " ORDER BY score DESC NULLS LAST, id"
    )
    labels = ", ".join(f"{n}, {n}_confidence" for n in LABEL_NAMES)
    return {
        "posts_bronze": (bronze, "SELECT * FROM bronze"),
        "standardized_posts": (bronze, f"SELECT * REPLACE ({TRIMMED}) FROM bronze"),
        "posts_silver": (silver, "SELECT * FROM silver"),
        "posts_staged": (gold, f"SELECT {', '.join(STAGED_COLUMNS)} FROM gold"),
        "safe_posts": (bronze, "SELECT id, over_18, load_date FROM bronze"
                               " WHERE over_18 = FALSE OR over_18 IS NULL"),
        "daily_top_posts": (bronze, THE_DAY),
        "top_posts_per_day": (bronze, f"""
  SELECT *, CAST(created_at AS DATE) AS load_day FROM bronze
  WHERE coalesce(over_18, FALSE) = FALSE
  QUALIFY row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY score DESC, id)
    <= {POSTS_PER_DAY}"""),
        "load_summary": (bronze + f",\nday AS ({THE_DAY})", """
  SELECT min(score) AS min_score, max(score) AS max_score,
    count(DISTINCT subreddit) AS unique_subreddits FROM day"""),
        "load_top_subreddits": (bronze + f",\nday AS ({THE_DAY})", """
  SELECT subreddit, count(*) AS post_count FROM day WHERE subreddit IS NOT NULL
  GROUP BY subreddit ORDER BY post_count DESC, subreddit LIMIT 5"""),
        "bronze_summary": (bronze, """
  SELECT CAST(created_at AS DATE) AS post_date, count(*) AS post_count, min(score) AS min_score,
    max(score) AS max_score, CAST(sum(score) AS DOUBLE) / count(score) AS avg_score,
    count(DISTINCT subreddit) AS unique_subreddits, count(DISTINCT author) AS unique_authors
  FROM bronze GROUP BY 1 ORDER BY post_date DESC NULLS LAST LIMIT 31"""),
        "bot_flags": (silver, "SELECT id, load_date, author, is_bot FROM cleaned"),
        "strict_bot_flags": (silver, f"""
  SELECT id, load_date, author,
    coalesce(regexp_matches(lower(author), '{STRICT_BOT_PATTERN}'), FALSE) AS is_bot
  FROM cleaned"""),
        "spam_flags": (silver, f"""
  SELECT id, load_date, title, {CHAR_RUN} AS has_char_spam, {SPECIAL} AS excessive_special_chars,
    {HIGH} AS suspiciously_high_score FROM cleaned"""),
        "null_report": (silver + f",\nn AS (SELECT {NULLS} FROM cleaned)",
                        f"SELECT *, {NULLS_TOTAL} FROM n"),
        "spam_report": (silver + f",\ns AS (SELECT {SPAMS} FROM cleaned)",
                        f"SELECT *, {SPAM_TOTAL} FROM s"),
        "bot_report": (silver, f"SELECT {BOTS} FROM cleaned"),
        "dedup_report": (bronze, """
  SELECT count(*) AS initial_count, count(DISTINCT id) AS final_count,
    count(*) - count(DISTINCT id) AS duplicates_removed FROM bronze"""),
        "quality_summary": (
            silver + f",\nn AS (SELECT {NULLS} FROM cleaned),\ns AS (SELECT {SPAMS} FROM cleaned)"
            f",\nb AS (SELECT {BOTS} FROM cleaned)",
            f"SELECT n.*, {NULLS_TOTAL}, s.*, {SPAM_TOTAL}, b.* FROM n, s, b",
        ),
        "silver_metrics": (silver, f"""
  SELECT count(*) AS total_records, {_n("is_bot")} AS bot_records,
    {_pct(_n("is_bot"))} AS bot_pct, count(DISTINCT id) AS unique_posts,
    count(DISTINCT author) AS unique_authors, count(DISTINCT subreddit) AS unique_subreddits,
    min(created_at) AS earliest_post, max(created_at) AS latest_post FROM silver"""),
        "enrich_sentiment": (gold, "SELECT id, sentiment, sentiment_confidence FROM gold"),
        "enrich_gold": (gold, f"SELECT id, {labels} FROM gold"),
        "model_scores": (silver + ",", TONE),
        "sentiment_by_subreddit": (gold, SENTIMENT_MART),
        "topic_trends": (gold, TOPIC_MART),
        "emotion_analysis": (gold, EMOTION_MART),
        "daily_metrics": (gold, DAILY_MART),
        "sentiment_distribution_confidence": (gold, _labels("sentiment")),
        "emotion_distribution_confidence": (gold, _labels("emotion")),
        "topic_distribution_confidence": (gold, _labels("topic")),
        "label_metric_keys": (gold, " UNION ALL ".join(_keys(k) for k in LABEL_NAMES) + """
  UNION ALL SELECT 'total_records_processed', count(*) FROM gold"""),
        "sentiment_heatmap": (gold, "SELECT subreddit, " + ", ".join(
            _n(f"sentiment = '{s}'") + f" AS {s}" for s in ("positive", "negative", "neutral")
        ) + " FROM gold GROUP BY subreddit"),
        "emotion_by_subreddit": (gold, """
  SELECT subreddit, emotion, count(*) AS count,
    CAST(sum(CAST(emotion_confidence AS DECIMAL(7,6))) AS DOUBLE) / count(*) AS avg_confidence
  FROM gold GROUP BY subreddit, emotion"""),
        "topics_over_time": (gold, """
  SELECT CAST(created_at AS DATE) AS date, topic, count(*) AS posts FROM gold GROUP BY 1, 2"""),
        "topic_scores": (gold, """
  SELECT topic, count(*) AS post_count, CAST(sum(score) AS DOUBLE) / count(score) AS avg_score
  FROM gold GROUP BY topic"""),
        "top_subreddit_sentiment": (gold + f",\nmart AS ({SENTIMENT_MART})", """
  SELECT subreddit, positive_pct, negative_pct, total_posts FROM mart
  ORDER BY total_posts DESC, subreddit LIMIT 10"""),
        "topics_by_posts": (gold + f",\nmart AS ({TOPIC_MART})",
                            "SELECT topic, post_count, avg_score FROM mart"),
        "daily_sentiment": (gold + f",\nmart AS ({DAILY_MART})", """
  SELECT post_date, positive_posts, negative_posts, neutral_posts FROM mart"""),
        "subreddit_baseline": (gold + """,
days AS (
  SELECT subreddit, CAST(created_at AS DATE) AS post_date, count(*) AS posts,
    CAST(count(*) FILTER (WHERE sentiment = 'positive')
      - count(*) FILTER (WHERE sentiment = 'negative') AS DOUBLE) / count(*) AS share
  FROM gold WHERE subreddit IS NOT NULL GROUP BY 1, 2
),
past AS (
  SELECT *, avg(share) OVER w AS mean, stddev_samp(share) OVER w AS spread FROM days
  WINDOW w AS (PARTITION BY subreddit ORDER BY post_date
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)""", """
  SELECT subreddit, post_date, posts, round(share, 6) AS net, round(mean, 6) AS baseline,
    CASE WHEN spread > 1e-9 THEN round((share - mean) / spread, 6) END AS deviation FROM past"""),
        "emotion_trend": (gold + """,
days AS (
  SELECT CAST(created_at AS DATE) AS post_date, emotion, count(*) AS posts FROM gold
  WHERE emotion IS NOT NULL GROUP BY 1, 2
)""", """
  SELECT post_date, emotion, posts,
    posts - lag(posts) OVER (PARTITION BY emotion ORDER BY post_date) AS change,
    round(CAST(sum(posts) OVER w AS DOUBLE) / count(posts) OVER w, 6) AS moving_average
  FROM days
  WINDOW w AS (PARTITION BY emotion ORDER BY post_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
        "sentiment_alerts": (gold + f""",
days AS (
  SELECT CAST(created_at AS DATE) AS post_date, count(*) AS posts,
    CAST({_n("sentiment = 'negative'")} AS DOUBLE) / count(*) AS share
  FROM gold WHERE created_at IS NOT NULL GROUP BY 1
),
past AS (
  SELECT *, avg(share) OVER w AS mean, stddev_samp(share) OVER w AS spread FROM days
  WINDOW w AS (ORDER BY post_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)""", """
  SELECT post_date, posts, round(share, 6) AS negative_share, round(mean, 6) AS trailing_mean,
    round(spread, 6) AS trailing_stddev,
    coalesce(round(abs(share - mean) - 2.0::DOUBLE * spread, 6) > 0, FALSE) AS alert FROM past"""),
        "conversation_sentiment": (_gold(TURNS, ["conv_id", "role"], prose_scorers()[:1]), f"""
  SELECT conv_id, role, count(*) AS turns, {_feelings("turns")},
    {_avg_confidence("sentiment_confidence")} AS avg_sentiment_confidence
  FROM gold GROUP BY conv_id, role"""),
        "lang_sentiment": ("parts AS (" + " UNION ALL ".join(_language_parts()) + ")", f"""
  SELECT lang, sentiment, count(*) AS documents,
    {_avg_confidence("sentiment_confidence")} AS avg_confidence
  FROM parts GROUP BY lang, sentiment"""),
        "confusion_matrix": (CONFUSION, "SELECT * FROM matrix"),
        "scorer_quality": (CONFUSION, """
  SELECT label, CAST(sum(n) FILTER (WHERE truth = label) AS BIGINT) AS support,
    CAST(coalesce(sum(n) FILTER (WHERE truth = label AND predicted = label), 0) AS BIGINT) AS hits,
    round(CAST(hits AS DOUBLE) / sum(n) FILTER (WHERE predicted = label), 6) AS precision,
    round(CAST(hits AS DOUBLE) / support, 6) AS recall,
    round(2.0::DOUBLE * hits / (support + sum(n) FILTER (WHERE predicted = label)), 6) AS f1
  FROM matrix, (SELECT truth AS label FROM matrix UNION SELECT predicted FROM matrix)
  GROUP BY label"""),
        "subreddit_topics": (
            _gold(SILVER, ["id", "subreddit"], prose_scorers()[2:],
                  "(subreddit = 'src7' OR (CAST(substring(subreddit, 4) AS INTEGER) + {i}) % 3 <> 0)"),
            "SELECT * FROM gold"),
        "author_degrees": (MEMBERS, "SELECT author, count(*) AS subreddits FROM members GROUP BY author"),
        "subreddit_similarity": (ALIKE_PAIRS, "SELECT * FROM edges"),
        "subreddit_graph": (GRAPH, """
  SELECT subreddit, n AS authors, coalesce(neighbours, 0) AS neighbours, coalesce(shared, 0) AS shared,
    s.other AS strongest, (SELECT min(r.other) FROM reached r WHERE r.node = subreddit) AS community
  FROM sizes LEFT JOIN around a ON a.node = subreddit LEFT JOIN strongest s ON s.node = subreddit"""),
        "learned_words": (MARKED, "SELECT * FROM learned"),
        "word_table_verdicts": (WORD_VERDICTS, """
  SELECT doc_id,
    CASE WHEN NOT regexp_matches(text, '\\S') OR clean >= toxic THEN 'clean' ELSE 'toxic' END AS verdict,
    CASE WHEN NOT regexp_matches(text, '\\S') THEN 0.0::DOUBLE
      ELSE round(1.0::DOUBLE / (exp(clean - greatest(clean, toxic)) + exp(toxic - greatest(clean, toxic))), 6) END
      AS verdict_confidence
  FROM every"""),
        "incremental_gold": (gold, f"SELECT {', '.join(STAGED_COLUMNS)} FROM gold"),
        "incremental_sentiment_by_subreddit": (gold, SENTIMENT_MART),
        "incremental_topic_trends": (gold, f"SELECT * EXCLUDE (related_subreddits) FROM ({TOPIC_MART})"),
        "incremental_topic_subreddits": (gold, """
  SELECT topic, subreddit, count(*) AS posts FROM gold WHERE topic IS NOT NULL AND subreddit IS NOT NULL GROUP BY 1, 2"""),
        "incremental_emotion_analysis": (gold, EMOTION_MART),
        "incremental_daily_metrics": (gold, DAILY_MART),
        "kpis_from_states": (silver, KPI),
        "kpis_filtered_from_states": (silver, f"{KPI} WHERE {DAYS} AND {SUBS}"),
        "kpis": (silver, KPI),
        "kpis_filtered": (silver, f"{KPI} WHERE {DAYS} AND {SUBS}"),
        "daily_trends": (silver, f"{TREND} GROUP BY 1"),
        "daily_trends_filtered": (silver, f"{TREND} WHERE {DAYS} AND {SUBS} GROUP BY 1"),
        "top_subreddits": (silver, f"""
  SELECT subreddit, count(*) AS post_count, {_sum("score")} AS total_score,
    {_avg("score", 1)} AS avg_score
  FROM silver WHERE {DAYS} GROUP BY subreddit ORDER BY post_count DESC, subreddit LIMIT 10"""),
        "dominant_sentiment": (gold + f""",
pairs AS (
  SELECT subreddit, sentiment, count(*) AS count FROM gold WHERE {DAYS} GROUP BY 1, 2
),
first AS (
  SELECT * FROM pairs
  QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY count DESC, sentiment) = 1
)""", "SELECT * FROM first ORDER BY count DESC, subreddit LIMIT 10"),
        "sentiment_distribution": (gold, _spread("sentiment", f"{DAYS} AND {SUBS}")),
        "emotion_distribution": (gold, _spread("emotion", DAYS, "LIMIT 10")),
        "topic_distribution": (gold, _spread("topic", DAYS, "LIMIT 10")),
        "available_dates": (silver, """
  SELECT min(CAST(created_at AS DATE)) AS min_date, max(CAST(created_at AS DATE)) AS max_date
  FROM silver"""),
        "available_subreddits": (silver, """
  SELECT DISTINCT subreddit FROM silver WHERE subreddit IS NOT NULL"""),
        "explore_recent": (silver, _page()),
        "explore_filtered": (silver, _page(f"{DAYS} AND {SUBS}")),
        "explore_page_by_score": (silver, _placed("score")),
        "explore_page_by_comments": (silver, _placed("num_comments")),
        "explore_all_by_score": (silver, _page(by="score")),
        "confident_negative": (gold, confident),
        "confident_negative_top10": (gold, f"{confident} LIMIT 10"),
        "sample_posts": (silver, """
  SELECT id, author, subreddit, title, score FROM silver ORDER BY id LIMIT 5"""),
        "sample_labelled_posts": (gold, f"""
  SELECT id, title, score, {labels} FROM gold ORDER BY id LIMIT 10"""),
        "range_load_bronze": (bronze, f"""
  SELECT * EXCLUDE (load_date), CAST(created_at AS DATE) AS load_day FROM bronze
  WHERE coalesce(over_18, FALSE) = FALSE
  QUALIFY row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY score DESC, id)
    <= {POSTS_PER_DAY}"""),
        "range_load_state": (bronze + """,
following AS (SELECT max(CAST(created_at AS DATE)) + 1 AS d FROM bronze)""", """
  SELECT strftime(d, '%Y') AS year, strftime(d, '%m') AS month, CAST(day(d) AS INTEGER) AS day
  FROM following"""),
        "stored_gold": (gold, f"SELECT {', '.join(STAGED_COLUMNS)} FROM gold"),
        "month_end_bronze": (bronze + f""",
moved AS (
  SELECT * EXCLUDE (load_date) REPLACE (created_at + INTERVAL {MOVED} DAY AS created_at, created_utc + {MOVED * 86400} AS created_utc)
  FROM bronze WHERE coalesce(over_18, FALSE) = FALSE
),
best AS (
  SELECT *, CAST(created_at AS DATE) AS load_day FROM moved
  QUALIFY row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY score DESC, id) <= {POSTS_PER_DAY}
),
runs AS (SELECT unnest([0, 1, 2]) AS run)""", """
  SELECT best.*, TIMESTAMP '2024-03-01' + INTERVAL 1 HOUR * (load_day - DATE '2024-01-30') AS load_date, CAST(run AS INTEGER) AS run
  FROM best, runs WHERE load_day BETWEEN DATE '2024-01-30' AND DATE '2024-01-30' + run
    AND month(load_day) = month(DATE '2024-01-30' + run)"""),
        "month_end_state": (bronze, "SELECT '2024' AS year, '02' AS month, 2 AS day"),
        "rescored_gold": (gold, f"SELECT {', '.join(STAGED_COLUMNS)} FROM gold"),
        "stored_sentiment_by_subreddit": (gold, SENTIMENT_MART),
        "stored_topic_trends": (gold, TOPIC_MART),
        "stored_emotion_analysis": (gold, EMOTION_MART),
        "stored_daily_metrics": (gold, DAILY_MART),
        "run_metrics": (gold + ",\nm AS (" + " UNION ALL ".join(_keys(k) for k in LABEL_NAMES) + """
  UNION ALL SELECT 'total_records_processed', count(*) FROM gold)""", """
  SELECT 'check' AS run_id, key, CAST(value AS VARCHAR) AS value FROM m
  UNION ALL SELECT 'check', unnest(['sentiment_errors_count', 'emotion_errors_count',
    'topic_errors_count']), '0'"""),
        "write_check": (silver, """
  SELECT layer, n AS expected, n AS actual, TRUE AS ok
  FROM (SELECT count(*) AS n FROM silver), (SELECT unnest(['silver', 'gold']) AS layer)"""),
        "csv_round_trip": (silver, f"{TREND} GROUP BY 1"),
        "stream_dedup": (bronze, """
  SELECT * FROM bronze
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_date, score) = 1"""),
        "stream_silver": (silver, "SELECT * FROM silver"),
        "stream_daily": (FIRST_GOLD, DAILY_MART),
        "stream_closed_days": (FIRST_GOLD, f"""
  SELECT * FROM ({DAILY_MART}) WHERE post_date + INTERVAL 1 DAY
    <= (SELECT max(created_utc) FROM bronze)::DOUBLE * INTERVAL 1 SECOND + TIMESTAMP '1970-01-01'
      - INTERVAL {CLOSING_DELAY_DAYS} DAY"""),
    }


def oracle_sql() -> dict[str, str]:
    """Name to SQL text."""
    return {name: _after(ctes, body) for name, (ctes, body) in _bodies().items()}
