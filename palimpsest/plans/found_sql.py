"""DuckDB statements of the general data problems, by plainer methods than the operators'."""

#: dd: (id, effects, day) of the decisions, days by one pattern for each spelling; instants in Berlin.
DECIDED = r"""dv AS (SELECT DISTINCT id, effects, trim(decision_date) AS v FROM decisions),
dp AS (SELECT *, regexp_extract(v, '^([0-9]{1,2})(?:\.|er)? ?([A-Za-zäöüéûÄÖÜÉ]+)\.? ([0-9]{4})$', ['d', 'm', 'y']) AS w, regexp_extract(v, '^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$', ['d', 'm', 'y']) AS n FROM dv),
dm AS (SELECT *, lower(w.m) AS name FROM dp),
dd AS (SELECT id, effects, CASE
  WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(v AS DATE)
  WHEN regexp_full_match(v, '[0-9]{8}') THEN try_cast(substr(v, 1, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2) AS DATE)
  WHEN regexp_full_match(v, '[0-9]{9,10}') THEN CAST(timezone('Europe/Berlin', to_timestamp(CAST(v AS BIGINT))) AS DATE)
  WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})') THEN CAST(timezone('Europe/Berlin', try_cast(v AS TIMESTAMPTZ)) AS DATE)
  WHEN n.y <> '' THEN try_cast(n.y || '-' || lpad(n.m, 2, '0') || '-' || lpad(n.d, 2, '0') AS DATE)
  WHEN w.y <> '' THEN try_cast(w.y || '-' || lpad(CAST(coalesce(
    nullif(list_position(['januar', 'februar', 'märz', 'april', 'mai', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'dezember'], name), 0),
    nullif(list_position(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'], name), 0),
    nullif(list_position(['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'], name), 0)) AS VARCHAR), 2, '0') || '-' || lpad(w.d, 2, '0') AS DATE)
  END AS day FROM dm)""".replace("\\\\", "\\")

SQL = {
    "p1_found": """
WITH iv AS (
  SELECT DISTINCT lower(trim(act_id)) AS act_id, interval_span.effective_from AS f,
    CASE WHEN interval_span.effective_to IS NULL OR interval_span.effective_to >= DATE '9999-12-31' THEN DATE '9999-12-31' ELSE interval_span.effective_to END AS t
  FROM verified_reconstruction_reviews WHERE interval_span.effective_from IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY act_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM iv WHERE f < t),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY act_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT act_id, min(f) AS f, max(t) AS t FROM numbered GROUP BY act_id, island),
following AS (SELECT *, lead(f) OVER (PARTITION BY act_id ORDER BY f) AS n FROM periods)
SELECT act_id, 'period' AS kind, CAST(f AS VARCHAR) AS from_day, CASE WHEN t = DATE '9999-12-31' THEN '' ELSE CAST(t AS VARCHAR) END AS to_day FROM following
UNION ALL SELECT act_id, 'gap', CAST(t AS VARCHAR), CAST(n AS VARCHAR) FROM following WHERE n IS NOT NULL
""",
    "p3_found": """
SELECT DISTINCT a.change_id, r.assertion_id
FROM act_archive a JOIN retrospective_store r ON lower(trim(a.act_id)) = lower(trim(r.act_id))
WHERE r.effective_from <= a.effective_date AND (r.effective_to IS NULL OR a.effective_date < r.effective_to)
  AND r.knowledge_from <= a.recorded_at AND (r.knowledge_to IS NULL OR a.recorded_at < r.knowledge_to)
""",
    "p6_found": """
WITH latest AS (
  SELECT lower(trim(act_id)) AS act_id, observed_at, lower(nullif(regexp_extract(state_sha256, '[0-9A-Fa-f]{64}'), '')) AS digest,
    row_number() OVER (PARTITION BY lower(trim(act_id)), observed_at ORDER BY received_at DESC, lower(nullif(regexp_extract(state_sha256, '[0-9A-Fa-f]{64}'), '')) DESC NULLS LAST) AS pick
  FROM state_observations),
numbers AS (SELECT observed_at, row_number() OVER (ORDER BY observed_at) AS n FROM (SELECT DISTINCT observed_at FROM state_observations)),
placed AS (SELECT l.act_id, n.n, l.digest, n.n - row_number() OVER (PARTITION BY l.act_id ORDER BY n.n) AS island FROM latest l JOIN numbers n USING (observed_at) WHERE pick = 1),
filled AS (SELECT act_id, n, last_value(digest IGNORE NULLS) OVER (PARTITION BY act_id, island ORDER BY n ROWS UNBOUNDED PRECEDING) AS digest FROM placed),
pairs AS (
  SELECT coalesce(b.act_id, a.act_id) AS act_id, coalesce(b.n, a.n + 1) AS n, a.act_id IS NULL AS is_new, b.act_id IS NULL AS is_gone, a.digest IS DISTINCT FROM b.digest AS differs
  FROM filled a FULL OUTER JOIN filled b ON a.act_id = b.act_id AND b.n = a.n + 1)
SELECT p.act_id, CAST(n.observed_at AS VARCHAR) AS observed_at, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS change_kind
FROM pairs p JOIN numbers n ON p.n = n.n WHERE n.n > 1 AND (is_new OR is_gone OR differs)
""",
    "p7_found": """
WITH latest AS (
  SELECT id, observed_at, event_id, nfc_normalize(trim(to_status)) AS to_status, nfc_normalize(trim(stage)) AS stage,
    row_number() OVER (PARTITION BY event_id ORDER BY received_at DESC, id DESC, observed_at DESC, to_status DESC NULLS LAST, stage DESC NULLS LAST) AS pick
  FROM procedure_watch_history),
events AS (SELECT * FROM latest WHERE pick = 1 AND to_status IS NOT NULL),
compared AS (
  SELECT *, row_number() OVER w AS place, lag(to_status) OVER w AS old_status, lag(stage) OVER w AS old_stage FROM events
  WINDOW w AS (PARTITION BY id ORDER BY observed_at, event_id)),
starts AS (SELECT * FROM compared WHERE place = 1 OR to_status IS DISTINCT FROM old_status OR stage IS DISTINCT FROM old_stage)
SELECT id, to_status, stage, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS valid_from,
  coalesce(strftime(lead(observed_at) OVER (PARTITION BY id ORDER BY observed_at, event_id), '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS valid_to
FROM starts
""",
}
