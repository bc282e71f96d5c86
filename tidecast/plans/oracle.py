"""DuckDB SQL equal in meaning to each query in ``plans.catalog``.

Tables ``orders lineitem customer nation part ...`` are views over the
same parquet files. DuckDB specifics handled here: ``date_trunc`` returns
TIMESTAMP (cast to DATE), literals like ``0.5`` are DECIMAL (cast to
DOUBLE), integer sums widen to HUGEINT (cast to BIGINT/DOUBLE).
"""

from __future__ import annotations

from .views import AS_OF_SQL, with_views

ORACLE: dict[str, str] = {}

MONTH = "CAST(date_trunc('month', {c}) AS DATE)"


def month(c: str) -> str:
    return MONTH.format(c=c)


# Monthly pull counts, one row per observed month.
PULLS_MONTHLY = f"""pm AS (
  SELECT repo, {month('created_at')} AS ds, CAST(count(*) AS DOUBLE) AS y
  FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL)"""

ORACLE["pulls_ses_forecast"] = with_views("pulls", recursive=True) + f""",
{PULLS_MONTHLY},
s AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) AS t,
             count(*) OVER (PARTITION BY repo) AS n FROM pm),
e AS (SELECT * FROM s WHERE n >= 6),
grid AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS alpha FROM range(1, 100) r(i)),
rec AS (
  SELECT e.repo, g.alpha, e.t, e.y AS level, CAST(0 AS DOUBLE) AS sse FROM e CROSS JOIN grid g WHERE e.t = 1
  UNION ALL
  SELECT r.repo, r.alpha, e.t, r.alpha * e.y + (CAST(1 AS DOUBLE) - r.alpha) * r.level,
         r.sse + (e.y - r.level) * (e.y - r.level)
  FROM rec r JOIN e ON e.repo = r.repo AND e.t = r.t + 1),
fin AS (SELECT r.*, l.ds AS last_ds FROM rec r JOIN e l ON l.repo = r.repo AND l.t = l.n AND r.t = l.n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY sse, alpha) AS rn FROM fin) WHERE rn = 1)
SELECT repo, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, round(alpha, 4) AS alpha, round(level, 4) AS yhat
FROM best, range(1, 13) h(k)
"""


# ---------------------------------------------------------------- issues
def _by_month_text(col: str) -> str:
    return with_views("issues") + f"""
SELECT repo, strftime({col}, '%Y-%m') AS month, count(*) AS n
FROM issues WHERE {col} IS NOT NULL GROUP BY ALL"""


ORACLE["issues_created_by_month"] = _by_month_text("created_at")
ORACLE["issues_closed_by_month"] = _by_month_text("closed_at")

ORACLE["issues_peak_days"] = with_views("issues") + """,
cw AS (SELECT repo, dayname(created_at) AS v, isodow(created_at) AS p, count(*) AS n
       FROM issues WHERE created_at IS NOT NULL GROUP BY ALL),
kw AS (SELECT repo, dayname(closed_at) AS v, isodow(closed_at) AS p, count(*) AS n
       FROM issues WHERE closed_at IS NOT NULL GROUP BY ALL),
km AS (SELECT repo, monthname(closed_at) AS v, month(closed_at) AS p, count(*) AS n
       FROM issues WHERE closed_at IS NOT NULL GROUP BY ALL),
a AS (SELECT repo, v FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) rn FROM cw) WHERE rn = 1),
b AS (SELECT repo, v FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) rn FROM kw) WHERE rn = 1),
c AS (SELECT repo, v FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) rn FROM km) WHERE rn = 1)
SELECT r.repo, a.v AS max_created_day_of_week, b.v AS max_closed_day_of_week, c.v AS max_closed_month_of_year
FROM (SELECT DISTINCT repo FROM issues) r
LEFT JOIN a ON a.repo = r.repo LEFT JOIN b ON b.repo = r.repo LEFT JOIN c ON c.repo = r.repo"""

ORACLE["weekday_histogram"] = with_views("pulls") + """
SELECT repo, dayname(created_at) AS weekday, count(*) AS n FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL"""

ORACLE["month_histogram"] = with_views("pulls") + """
SELECT repo, monthname(created_at) AS month_name, count(*) AS n FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL"""

_WINDOWS = f"""wb AS (
  SELECT 1 AS window_idx, CAST({AS_OF_SQL} - INTERVAL 1 MONTH AS DATE) AS lo, {AS_OF_SQL} AS hi
  UNION ALL
  SELECT window_idx + 1, CAST(lo - INTERVAL 1 MONTH AS DATE), lo FROM wb WHERE window_idx < 12),
iw AS (
  SELECT i.*, wb.window_idx FROM issues i JOIN wb
    ON i.created_at <= wb.hi AND (i.created_at > wb.lo OR (wb.window_idx = 12 AND i.created_at = wb.lo)))"""

ORACLE["issues_in_windows"] = with_views("issues", recursive=True) + f""",
{_WINDOWS}
SELECT repo, issue_number, created_at, closed_at, window_idx FROM iw"""

ORACLE["issues_in_windows_capped"] = with_views("issues", recursive=True) + f""",
{_WINDOWS}
SELECT *, CAST(ceil(rank_in_window / 100.0) AS BIGINT) AS page FROM (
  SELECT repo, issue_number, created_at, window_idx,
         row_number() OVER (PARTITION BY repo, window_idx ORDER BY created_at, issue_number) AS rank_in_window
  FROM iw)"""


# ---------------------------------------------------------- monthly series
def _monthly(view: str, col: str, value: str = "count(*)") -> str:
    return f"""SELECT repo, {month(col)} AS ds, CAST({value} AS DOUBLE) AS y
FROM {view} WHERE {col} IS NOT NULL GROUP BY ALL"""


ORACLE["pulls_monthly"] = with_views("pulls") + "\n" + _monthly("pulls", "created_at")
ORACLE["commits_monthly"] = with_views("commits") + "\n" + _monthly("commits", '"date"')
ORACLE["releases_monthly"] = with_views("releases") + "\n" + _monthly("releases", "published_at")

SYNTH_BRANCHES = f"""sb AS (
  SELECT repo, CAST({AS_OF_SQL} - CAST(n AS INTEGER) + CAST(i AS INTEGER) AS DATE) AS day FROM (
    SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY seq) - 1 AS i,
           count(*) OVER (PARTITION BY repo) AS n FROM branches))"""

SYNTH_CONTRIB = f"""sc AS (
  SELECT repo, name, contributions, i AS position,
         CAST({AS_OF_SQL} - CAST(n AS INTEGER) + CAST(i AS INTEGER) AS DATE) AS day FROM (
    SELECT repo, name, contributions,
           row_number() OVER (PARTITION BY repo ORDER BY contributions DESC, seq) - 1 AS i,
           count(*) OVER (PARTITION BY repo) AS n FROM contributors))"""

ORACLE["branches_monthly"] = with_views("branches") + f""",
{SYNTH_BRANCHES}
{_monthly("sb", "day")}"""

ORACLE["contributors_monthly"] = with_views("contributors") + f""",
{SYNTH_CONTRIB}
{_monthly("sc", "day", "sum(contributions)")}"""

ORACLE["contributors_timeline"] = with_views("contributors") + f""",
{SYNTH_CONTRIB}
SELECT repo, name, contributions, position, day AS synthetic_day FROM sc"""

ORACLE["pulls_month_profile"] = with_views("pulls") + """
SELECT repo, month(created_at) AS month, count(*) AS n FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL"""

ISSUES_DAILY = """idc AS (
  SELECT repo, CAST(created_at AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
  FROM issues WHERE created_at IS NOT NULL GROUP BY ALL)"""

ORACLE["issues_daily_count"] = with_views("issues") + f""",
{ISSUES_DAILY}
SELECT * FROM idc"""

ORACLE["issues_daily_sum_number"] = with_views("issues") + """
SELECT repo, CAST(created_at AS DATE) AS ds, CAST(sum(issue_number) AS DOUBLE) AS y
FROM issues WHERE created_at IS NOT NULL GROUP BY ALL"""


def fill(src: str, unit: str, name: str) -> str:
    """Dense grid CTE ``name`` over CTE ``src`` (repo, ds, y)."""
    return f"""{name}_b AS (SELECT repo, min(ds) AS lo, max(ds) AS hi FROM {src} GROUP BY repo),
{name}_g AS (SELECT repo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 {unit})) AS DATE) AS ds FROM {name}_b),
{name} AS (SELECT g.repo, g.ds, coalesce(s.y, CAST(0 AS DOUBLE)) AS y
           FROM {name}_g g LEFT JOIN {src} s ON s.repo = g.repo AND s.ds = g.ds)"""


RELEASES_MONTHLY = f"""rm AS ({_monthly("releases", "published_at")})"""

ORACLE["releases_monthly_filled"] = with_views("releases") + f""",
{RELEASES_MONTHLY},
{fill("rm", "MONTH", "rmf")}
SELECT * FROM rmf"""

ORACLE["issues_daily_filled"] = with_views("issues") + f""",
{ISSUES_DAILY},
{fill("idc", "DAY", "idf")}
SELECT * FROM idf"""

ORACLE["recent_releases"] = with_views("releases") + f"""
SELECT repo, name, CAST(strptime(published_text, '%Y-%m-%dT%H:%M:%SZ') AS DATE) AS published_at
FROM releases
WHERE published_at >= CAST({AS_OF_SQL} AS TIMESTAMP) - INTERVAL 730 DAY
  AND nullif(published_text, '') IS NOT NULL
  AND try_strptime(published_text, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL"""

ORACLE["repo_validation"] = """
WITH k AS (
  SELECT replace(p_name, ' ', '/') AS repo FROM part
  UNION SELECT p_brand FROM part
  UNION SELECT p_type || '/' || replace(p_name, ' ', '/') FROM part)
SELECT repo,
       CASE WHEN repo IS NULL OR repo = '' THEN 'invalid_repo'
            WHEN len(string_split(repo, '/')) = 2 THEN 'ok' ELSE 'invalid_repo' END AS status,
       CASE WHEN repo <> '' AND len(string_split(repo, '/')) = 2 THEN string_split(repo, '/')[1] END AS owner,
       CASE WHEN repo <> '' AND len(string_split(repo, '/')) = 2 THEN string_split(repo, '/')[2] END AS name
FROM k"""


# ------------------------------------------------------------- eligibility
GATES = """gates(metric, slot, estimator, min_records, min_points) AS (VALUES
  ('issues', 'lstm', 'lookback', 1, 0), ('issues', 'prophet', 'additive', 1, 0),
  ('issues', 'statsmodels', 'auto_order', 1, 0),
  ('pulls', 'lstm', 'index_trend', 1, 0), ('pulls', 'prophet', 'additive', 1, 0),
  ('pulls', 'statsmodels', 'smoothing', 1, 6),
  ('commits', 'lstm', 'index_trend', 1, 0), ('commits', 'prophet', 'additive', 1, 0),
  ('commits', 'statsmodels', 'ar5', 1, 12),
  ('branches', 'lstm', 'index_trend', 1, 0), ('branches', 'prophet', 'additive', 1, 0),
  ('branches', 'statsmodels', 'ar5', 1, 11),
  ('contributors', 'lstm', 'index_trend', 1, 0), ('contributors', 'prophet', 'additive', 1, 0),
  ('contributors', 'statsmodels', 'arma', 1, 6),
  ('releases', 'lstm', 'index_trend', 1, 0), ('releases', 'prophet', 'additive', 2, 0),
  ('releases', 'statsmodels', 'arma', 3, 0))"""

PULLS_M = f"""s_pulls AS (SELECT repo, 'pulls' AS metric, ds, y FROM ({_monthly("pulls", "created_at")}))"""
COMMITS_M = f"""s_commits AS (SELECT repo, 'commits' AS metric, ds, y FROM ({_monthly("commits", '"date"')}))"""
BRANCHES_M = f"""{SYNTH_BRANCHES},
s_branches AS (SELECT repo, 'branches' AS metric, ds, y FROM ({_monthly("sb", "day")}))"""
CONTRIB_M = f"""{SYNTH_CONTRIB},
s_contributors AS (SELECT repo, 'contributors' AS metric, ds, y FROM ({_monthly("sc", "day", "sum(contributions)")}))"""
RELEASES_M = f"""{RELEASES_MONTHLY},
{fill("rm", "MONTH", "rmf")},
s_releases AS (SELECT repo, 'releases' AS metric, ds, y FROM rmf)"""
ISSUES_D = f"""{ISSUES_DAILY},
{fill("idc", "DAY", "idf")},
s_issues AS (SELECT repo, 'issues' AS metric, ds, y FROM idf)"""

RECORDS = """r_all AS (
  SELECT repo, 'issues' AS metric, count(*) AS n_records FROM issues WHERE created_at IS NOT NULL GROUP BY repo
  UNION ALL SELECT repo, 'pulls', count(*) FROM pulls WHERE created_at IS NOT NULL GROUP BY repo
  UNION ALL SELECT repo, 'commits', count(*) FROM commits WHERE "date" IS NOT NULL GROUP BY repo
  UNION ALL SELECT repo, 'branches', count(*) FROM branches GROUP BY repo
  UNION ALL SELECT repo, 'contributors', count(*) FROM contributors GROUP BY repo
  UNION ALL SELECT repo, 'releases', count(*) FROM releases WHERE published_at IS NOT NULL GROUP BY repo)"""

MONTHLY_ALL = """m_all AS (
  SELECT * FROM s_pulls UNION ALL SELECT * FROM s_commits UNION ALL SELECT * FROM s_branches
  UNION ALL SELECT * FROM s_contributors UNION ALL SELECT * FROM s_releases)"""

BAD_KEY = "coalesce(len(string_split(nullif({c}, ''), '/')), 0) <> 2"

STATUS = f"""known AS (SELECT repo FROM s_every UNION SELECT 'nation/' || n_name FROM nation),
base AS (SELECT k.repo, m.metric FROM known k CROSS JOIN (SELECT DISTINCT metric FROM gates) m),
cnt AS (
  SELECT b.repo, b.metric, coalesce(r.n_records, 0) AS n_records, coalesce(p.n_points, 0) AS n_points
  FROM base b LEFT JOIN r_all r ON r.repo = b.repo AND r.metric = b.metric
  LEFT JOIN (SELECT repo, metric, count(*) AS n_points FROM s_every GROUP BY ALL) p
    ON p.repo = b.repo AND p.metric = b.metric),
st AS (
  SELECT c.repo, c.metric, g.slot, g.estimator, c.n_records, c.n_points,
         CASE WHEN {BAD_KEY.format(c='c.repo')} THEN 'invalid_repo'
              WHEN c.n_records = 0 THEN 'no_data'
              WHEN c.n_records < g.min_records OR c.n_points < g.min_points THEN 'not_enough_data'
              ELSE 'ok' END AS status
  FROM cnt c JOIN gates g ON g.metric = c.metric)"""

_ALL_VIEWS = ("issues", "pulls", "reported_commits", "branches", "contributors", "releases")

ORACLE["series_eligibility"] = with_views(*_ALL_VIEWS) + f""",
{GATES}, {PULLS_M}, {COMMITS_M}, {BRANCHES_M}, {CONTRIB_M}, {RELEASES_M}, {ISSUES_D}, {RECORDS},
{MONTHLY_ALL},
s_every AS (SELECT * FROM m_all UNION ALL SELECT * FROM s_issues),
{STATUS}
SELECT * FROM st"""

_MONTHLY_STATUS = with_views(*_ALL_VIEWS) + f""",
{GATES}, {PULLS_M}, {COMMITS_M}, {BRANCHES_M}, {CONTRIB_M}, {RELEASES_M}, {RECORDS},
{MONTHLY_ALL},
s_every AS (SELECT * FROM m_all),
{STATUS.replace("SELECT DISTINCT metric FROM gates", "SELECT DISTINCT metric FROM gates WHERE metric <> 'issues'")},
ok AS (SELECT repo, metric FROM st WHERE slot = 'statsmodels' AND status = 'ok')"""

ORACLE["eligible_series"] = _MONTHLY_STATUS + """
SELECT m.repo, m.metric, m.ds, m.y FROM m_all m WHERE EXISTS (
  SELECT 1 FROM ok WHERE ok.repo = m.repo AND ok.metric = m.metric)"""

ORACLE["rejected_series"] = _MONTHLY_STATUS + """
SELECT m.repo, m.metric, m.ds, m.y FROM m_all m WHERE NOT EXISTS (
  SELECT 1 FROM ok WHERE ok.repo = m.repo AND ok.metric = m.metric)"""


# ------------------------------------------------------------------ grids
ORACLE["future_month_starts"] = with_views("pulls") + f""",
{PULLS_MONTHLY}
SELECT repo, CAST(k AS INTEGER) AS step, CAST(max(ds) + to_months(CAST(k AS INTEGER)) AS DATE) AS ds
FROM pm, range(1, 13) h(k) GROUP BY repo, k"""

ORACLE["future_month_ends"] = with_views("pulls") + f""",
{PULLS_MONTHLY}
SELECT repo, CAST(k AS INTEGER) AS step,
       CAST(last_day(max(ds) + to_months(CAST(k AS INTEGER) - 1)) AS DATE) AS ds
FROM pm, range(1, 13) h(k) GROUP BY repo, k"""

ORACLE["future_days"] = with_views("issues") + f""",
{ISSUES_DAILY}
SELECT repo, ds, false AS future FROM idc
UNION ALL
SELECT repo, CAST(max(ds) + CAST(k AS INTEGER) AS DATE) AS ds, true AS future
FROM idc, range(1, 31) h(k) GROUP BY repo, k"""


# ---------------------------------------------------------- windows/splits
ORACLE["series_index_scaled"] = with_views("pulls") + f""",
{PULLS_MONTHLY},
x AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
             min(y) OVER (PARTITION BY repo) AS lo, max(y) OVER (PARTITION BY repo) AS hi FROM pm)
SELECT repo, ds, idx, y,
       round(CASE WHEN hi = lo THEN y - lo ELSE (y - lo) / (hi - lo) END, 4) AS y_scaled FROM x"""

ORACLE["series_split_ordered"] = with_views("pulls") + f""",
{PULLS_MONTHLY}
SELECT repo, ds, idx, CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT repo, ds, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
         count(*) OVER (PARTITION BY repo) AS n FROM pm)"""

ORACLE["series_split_hashed"] = with_views("pulls") + f""",
{PULLS_MONTHLY},
x AS (SELECT repo, ds, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
             count(*) OVER (PARTITION BY repo) AS n FROM pm),
h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5(repo || '|' || CAST(idx AS VARCHAR) || '|42')) AS hr
      FROM x)
SELECT repo, ds, idx,
       CASE WHEN n < 2 THEN 'both' WHEN hr <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM h"""

PULLS_DAILY_FILLED = """pdc AS (
  SELECT repo, CAST(created_at AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
  FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL),
""" + fill("pdc", "DAY", "pdf")

ORACLE["lookback_windows_30"] = with_views("pulls") + f""",
{PULLS_DAILY_FILLED},
sp AS (SELECT repo, ds, y, CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
         count(*) OVER (PARTITION BY repo) AS n FROM pdf)),
lb AS (SELECT repo, ds, split, y,
              list(y) OVER (PARTITION BY repo, split ORDER BY ds ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS x
       FROM sp)
SELECT repo, ds, split, array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS x, y
FROM lb WHERE len(x) = 30"""

ORACLE["diff_and_lags"] = with_views("commits") + f""",
cm AS ({_monthly("commits", '"date"')}),
d AS (SELECT repo, ds, y, y - lag(y) OVER (PARTITION BY repo ORDER BY ds) AS dy FROM cm)
SELECT repo, ds, y, dy,
       lag(dy, 1) OVER w AS lag1, lag(dy, 2) OVER w AS lag2, lag(dy, 3) OVER w AS lag3,
       lag(dy, 4) OVER w AS lag4, lag(dy, 5) OVER w AS lag5
FROM d WINDOW w AS (PARTITION BY repo ORDER BY ds)"""


# ------------------------------------------------------------------ models
COMMITS_MONTHLY = f"""cm AS ({_monthly("commits", '"date"')})"""

ORACLE["ar1_forecast"] = with_views("commits", recursive=True) + f""",
{COMMITS_MONTHLY},
d AS (SELECT repo, ds, y, y - lag(y) OVER (PARTITION BY repo ORDER BY ds) AS dy FROM cm),
l AS (SELECT repo, ds, dy, lag(dy) OVER (PARTITION BY repo ORDER BY ds) AS dy1 FROM d),
phi AS (SELECT repo, sum(dy * dy1) / sum(dy1 * dy1) AS phi FROM l
        WHERE dy IS NOT NULL AND dy1 IS NOT NULL GROUP BY repo),
lst AS (SELECT repo, max(ds) AS last_ds, arg_max(y, ds) AS last_y, arg_max(dy, ds) AS last_dy FROM d GROUP BY repo),
rec AS (
  SELECT p.repo, 1 AS step, p.phi, p.phi * l.last_dy AS d, l.last_y + p.phi * l.last_dy AS level, l.last_ds
  FROM phi p JOIN lst l ON l.repo = p.repo
  UNION ALL
  SELECT repo, step + 1, phi, phi * d, level + phi * d, last_ds FROM rec WHERE step < 12)
SELECT repo, step, CAST(last_ds + to_months(step) AS DATE) AS ds, round(phi, 4) AS phi, round(level, 4) AS yhat
FROM rec"""


def _gram_sql() -> str:
    parts = []
    for i in range(1, 6):
        for j in range(i, 6):
            parts.append(f"SELECT repo, 'xx' AS kind, {i} AS i, {j} AS j, sum(x{i} * x{j}) AS value FROM f GROUP BY repo")
    for i in range(1, 6):
        parts.append(f"SELECT repo, 'xy', {i}, 0, sum(x{i} * dy) FROM f GROUP BY repo")
    lags = ", ".join(f"lag(dy, {i}) OVER w AS x{i}" for i in range(1, 6))
    nn = " AND ".join(f"x{i} IS NOT NULL" for i in range(1, 6))
    return with_views("pulls") + f""",
{PULLS_MONTHLY},
d AS (SELECT repo, ds, y - lag(y) OVER (PARTITION BY repo ORDER BY ds) AS dy FROM pm),
l AS (SELECT repo, ds, dy, {lags} FROM d WINDOW w AS (PARTITION BY repo ORDER BY ds)),
f AS (SELECT * FROM l WHERE dy IS NOT NULL AND {nn})
""" + "\nUNION ALL\n".join(parts)


ORACLE["gram_entries"] = _gram_sql()

HASHED_TREND = f"""{PULLS_MONTHLY},
x AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
             count(*) OVER (PARTITION BY repo) AS n FROM pm),
h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5(repo || '|' || CAST(idx AS VARCHAR) || '|42')) AS hr
      FROM x),
sp AS (SELECT repo, ds, y, idx,
              CASE WHEN n < 2 THEN 'both' WHEN hr <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM h),
cf AS (SELECT repo, coalesce(regr_slope(y, idx), 0) AS slope,
              coalesce(regr_intercept(y, idx), avg(y)) AS intercept
       FROM sp WHERE split IN ('train', 'both') GROUP BY repo),
fit AS (SELECT sp.*, cf.intercept + cf.slope * sp.idx AS yhat FROM sp JOIN cf ON cf.repo = sp.repo)"""

ORACLE["index_trend_fit"] = with_views("pulls") + f""",
{HASHED_TREND}
SELECT repo, ds, idx, split, y, round(yhat, 4) AS yhat FROM fit"""

ORACLE["index_trend_mse"] = with_views("pulls") + f""",
{HASHED_TREND}
SELECT repo, split, round(avg((y - yhat) * (y - yhat)), 4) AS mse FROM fit GROUP BY repo, split"""

HOLDOUT = f"""{PULLS_MONTHLY},
sp AS (SELECT repo, ds, y, idx, CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
         count(*) OVER (PARTITION BY repo) AS n FROM pm)),
cf AS (SELECT repo, coalesce(regr_slope(y, idx), 0) AS slope, coalesce(regr_intercept(y, idx), avg(y)) AS intercept
       FROM sp WHERE split = 'train' GROUP BY repo),
it AS (SELECT sp.repo, 'index_trend' AS model, sp.split AS segment, sp.ds, sp.y,
              cf.intercept + cf.slope * sp.idx AS yhat FROM sp JOIN cf ON cf.repo = sp.repo),
tr AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) AS t FROM sp WHERE split = 'train'),
grid AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS alpha FROM range(1, 100) r(i)),
rec AS (
  SELECT tr.repo, g.alpha, tr.t, tr.y AS level, CAST(0 AS DOUBLE) AS sse, CAST(NULL AS DOUBLE) AS pred
  FROM tr CROSS JOIN grid g WHERE tr.t = 1
  UNION ALL
  SELECT r.repo, r.alpha, tr.t, r.alpha * tr.y + (CAST(1 AS DOUBLE) - r.alpha) * r.level,
         r.sse + (tr.y - r.level) * (tr.y - r.level), r.level
  FROM rec r JOIN tr ON tr.repo = r.repo AND tr.t = r.t + 1),
lastt AS (SELECT repo, max(t) AS t FROM tr GROUP BY repo),
best AS (SELECT repo, alpha, level FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.repo ORDER BY r.sse, r.alpha) AS rn
  FROM rec r JOIN lastt l ON l.repo = r.repo AND l.t = r.t) WHERE rn = 1),
ses AS (
  SELECT tr.repo, 'ses' AS model, 'train' AS segment, tr.ds, tr.y, r.pred AS yhat
  FROM tr JOIN best b ON b.repo = tr.repo JOIN rec r ON r.repo = tr.repo AND r.alpha = b.alpha AND r.t = tr.t
  UNION ALL
  SELECT sp.repo, 'ses', 'test', sp.ds, sp.y, b.level FROM sp JOIN best b ON b.repo = sp.repo WHERE sp.split = 'test'),
hf AS (SELECT * FROM it UNION ALL SELECT * FROM ses)"""

ORACLE["actual_vs_predicted"] = with_views("pulls", recursive=True) + f""",
{HOLDOUT}
SELECT repo, model, segment, ds, y, round(yhat, 4) AS yhat FROM hf"""

ORACLE["model_comparison"] = with_views("pulls", recursive=True) + f""",
{HOLDOUT},
m AS (SELECT repo, model, avg((y - yhat) * (y - yhat)) AS mse FROM hf
      WHERE segment = 'test' AND yhat IS NOT NULL GROUP BY repo, model)
SELECT repo, model, round(mse, 4) AS mse,
       row_number() OVER (PARTITION BY repo ORDER BY mse, model) AS rank FROM m"""


# ----------------------------------------------------------------- reports
_ISSUE_REPORT = f"""{_WINDOWS},
cm AS (SELECT repo, strftime(created_at, '%Y-%m') AS m, count(*) AS n FROM iw GROUP BY ALL),
km AS (SELECT repo, strftime(closed_at, '%Y-%m') AS m, count(*) AS n FROM iw WHERE closed_at IS NOT NULL GROUP BY ALL),
ct AS (SELECT repo, string_agg(m || ':' || CAST(n AS VARCHAR), ',' ORDER BY m) AS t FROM cm GROUP BY repo),
kt AS (SELECT repo, string_agg(m || ':' || CAST(n AS VARCHAR), ',' ORDER BY m) AS t FROM km GROUP BY repo),
cw AS (SELECT repo, dayname(created_at) AS v, isodow(created_at) AS p, count(*) AS n
       FROM iw WHERE created_at IS NOT NULL GROUP BY ALL),
kw AS (SELECT repo, dayname(closed_at) AS v, isodow(closed_at) AS p, count(*) AS n
       FROM iw WHERE closed_at IS NOT NULL GROUP BY ALL),
kmn AS (SELECT repo, monthname(closed_at) AS v, month(closed_at) AS p, count(*) AS n
       FROM iw WHERE closed_at IS NOT NULL GROUP BY ALL),
a AS (SELECT repo, v FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) rn FROM cw) WHERE rn = 1),
b AS (SELECT repo, v FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) rn FROM kw) WHERE rn = 1),
c AS (SELECT repo, v FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, p) rn FROM kmn) WHERE rn = 1)"""

_ISSUE_REPORT_JOINS = """FROM (SELECT DISTINCT repo FROM iw) r
LEFT JOIN ct ON ct.repo = r.repo LEFT JOIN kt ON kt.repo = r.repo
LEFT JOIN a ON a.repo = r.repo LEFT JOIN b ON b.repo = r.repo LEFT JOIN c ON c.repo = r.repo"""

_ISSUE_REPORT_COLS = """ct.t AS created_issues_by_month, kt.t AS closed_issues_by_month,
       a.v AS max_created_day_of_week, b.v AS max_closed_day_of_week, c.v AS max_closed_month_of_year"""

ORACLE["issue_report_flat"] = with_views("issues", recursive=True) + f""",
{_ISSUE_REPORT}
SELECT r.repo, CAST(0 AS BIGINT) AS stars, CAST(0 AS BIGINT) AS forks, {_ISSUE_REPORT_COLS}
{_ISSUE_REPORT_JOINS}"""

ORACLE["metric_report_pulls"] = with_views("pulls") + f""",
{GATES}, {PULLS_M},
r_all AS (SELECT repo, 'pulls' AS metric, count(*) AS n_records FROM pulls WHERE created_at IS NOT NULL GROUP BY repo),
s_every AS (SELECT * FROM s_pulls),
{STATUS.replace("SELECT DISTINCT metric FROM gates", "SELECT 'pulls' AS metric")}
SELECT repo, any_value(n_records) AS n_records, any_value(n_points) AS n_points,
       max(CASE WHEN slot = 'lstm' THEN status END) AS lstm_status,
       max(CASE WHEN slot = 'prophet' THEN status END) AS prophet_status,
       max(CASE WHEN slot = 'statsmodels' THEN status END) AS statsmodels_status,
       CASE WHEN any_value(n_points) >= 24 THEN 'holt_winters' WHEN any_value(n_points) >= 6 THEN 'ses' END
         AS statsmodels_model
FROM st GROUP BY repo"""

ORACLE["status_report"] = ORACLE["series_eligibility"].replace(
    "SELECT * FROM st", """SELECT *, CASE WHEN repo IS NULL OR repo = '' THEN 'invalid_repo'
       WHEN len(string_split(repo, '/')) = 2 THEN 'ok' ELSE 'invalid_repo' END AS key_status FROM st""")

ORACLE["pulls_monthly_filled"] = with_views("pulls") + f""",
{PULLS_MONTHLY},
{fill("pm", "MONTH", "pmf")}
SELECT * FROM pmf"""

ORACLE["commits_daily_filled"] = with_views("commits") + f""",
cd AS (SELECT repo, CAST("date" AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
       FROM commits WHERE "date" IS NOT NULL GROUP BY ALL),
{fill("cd", "DAY", "cdf")}
SELECT * FROM cdf"""

ORACLE["pulls_profile_trend"] = with_views("pulls") + """,
p AS (SELECT repo, month(created_at) AS month, count(*) AS n FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL),
c AS (SELECT repo, coalesce(regr_slope(CAST(n AS DOUBLE), CAST(month AS DOUBLE)), 0) AS slope,
             coalesce(regr_intercept(CAST(n AS DOUBLE), CAST(month AS DOUBLE)), avg(n)) AS intercept
      FROM p GROUP BY repo)
SELECT p.repo, p.month, p.n, round(c.intercept + c.slope * p.month, 4) AS yhat FROM p JOIN c ON c.repo = p.repo"""

ORACLE["series_bounds"] = with_views("pulls") + f""",
{PULLS_MONTHLY}
SELECT repo, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS n_points FROM pm GROUP BY repo"""

ORACLE["record_counts"] = with_views("issues", "pulls", "commits", "branches", "contributors", "releases") + """
SELECT repo, 'issues' AS entity, count(*) AS n_records FROM issues GROUP BY repo
UNION ALL SELECT repo, 'pulls', count(*) FROM pulls GROUP BY repo
UNION ALL SELECT repo, 'commits', count(*) FROM commits GROUP BY repo
UNION ALL SELECT repo, 'branches', count(*) FROM branches GROUP BY repo
UNION ALL SELECT repo, 'contributors', count(*) FROM contributors GROUP BY repo
UNION ALL SELECT repo, 'releases', count(*) FROM releases GROUP BY repo"""

ORACLE["pulls_parsed_from_text"] = with_views("pulls") + """
SELECT repo, CAST(created_at AS DATE) AS ds, count(*) AS n, CAST(count(*) AS BIGINT) AS n_agree
FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL"""


# ---------------------------------------- landed records, built as JSON text
ORACLE["landed_issues"] = """
SELECT o_orderpriority AS repo, o_orderkey AS issue_number, CAST(o_orderdate AS DATE) AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate + INTERVAL 3 DAY AS DATE) END AS closed_at,
       lower(o_orderstatus) AS state, CASE WHEN o_orderkey % 89 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS author
FROM orders WHERE o_orderkey % 97 <> 0"""

ORACLE["landed_commits"] = """
SELECT l_returnflag AS repo, md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) AS sha,
       CASE WHEN (l_orderkey * 10 + l_linenumber) % 83 <> 0 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem"""

ORACLE["landed_branches"] = """
SELECT p_brand AS repo, p_name AS name, md5(CAST(p_partkey AS VARCHAR)) AS commit_sha, p_partkey AS seq FROM part"""

ORACLE["landed_contributors"] = """
SELECT c_mktsegment AS repo, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE 'unknown' END AS name,
       CAST(CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 100 ELSE 0 END AS BIGINT) AS contributions, c_custkey AS seq
FROM customer"""

ORACLE["landed_releases"] = """
SELECT o_orderpriority AS repo, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'unknown' END AS name,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day
FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0"""

ORACLE["landed_repositories"] = """
SELECT n_name AS repo, CAST(CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 10 ELSE 0 END AS BIGINT) AS stars,
       CAST(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey ELSE 0 END AS BIGINT) AS forks FROM nation"""

ORACLE["issues_refetched"] = with_views("issues") + """
SELECT repo, issue_number, created_at, closed_at FROM issues"""

ORACLE["commits_of_selected_repositories"] = with_views("commits") + f""",
sel AS (SELECT * FROM commits WHERE repo IN (
  SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < DATE '1996-01-01'))
{_monthly("sel", '"date"')}"""

ORACLE["order_value_series"] = f"""
SELECT o_orderpriority AS repo, {month('o_orderdate')} AS ds, round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS y
FROM orders GROUP BY ALL"""

ORACLE["missing_column_status"] = with_views("pulls") + f""",
{GATES}
SELECT p.repo, g.metric, g.slot, g.estimator, CAST(0 AS BIGINT) AS n_records, CAST(0 AS BIGINT) AS n_points,
       'no_column' AS status
FROM (SELECT DISTINCT repo FROM pulls) p CROSS JOIN gates g WHERE g.metric = 'pulls'"""


def _recent(view: str, col: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM {view} WHERE {col} >= CAST({AS_OF_SQL} AS TIMESTAMP) - INTERVAL 730 DAY)"""


ORACLE["pulls_recent_monthly"] = with_views("pulls") + f""",
{_recent("pulls", "created_at", "rec")}
{_monthly("rec", "created_at")}"""

ORACLE["commits_recent_monthly"] = with_views("commits") + f""",
{_recent("commits", '"date"', "rec")}
{_monthly("rec", '"date"')}"""


# -------------------------------------------------------------- smoothing
Z80 = "CAST(1.2815515655446004 AS DOUBLE)"


def _smoothing(src: str, ses: bool = True) -> str:
    """Holt-Winters over 24 points or more and, with ``ses``, SES over 6 to
    23, by recursion over the same parameter grids as the folds."""
    hw = f"""
hs AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) AS t,
              count(*) OVER (PARTITION BY repo) AS n FROM {src}),
h0 AS (SELECT repo, avg(y) AS lvl, list(y ORDER BY t) AS ys FROM hs WHERE t <= 12 GROUP BY repo),
hg AS (SELECT CAST(i AS DOUBLE) / 20 AS a, CAST(j AS DOUBLE) / 20 AS g FROM range(1, 20) r(i), range(1, 20) q(j)
       WHERE i + j <= 20),
hr AS (
  SELECT h0.repo, hg.a, hg.g, CAST(0 AS BIGINT) AS t, h0.lvl AS level,
         list_transform(h0.ys, lambda v: v - h0.lvl) AS season, CAST(0 AS DOUBLE) AS sse
  FROM h0 CROSS JOIN hg WHERE h0.repo IN (SELECT repo FROM hs WHERE n >= 24)
  UNION ALL
  SELECT r.repo, r.a, r.g, s.t,
         r.a * (s.y - r.season[(s.t - 1) % 12 + 1]) + (1 - r.a) * r.level,
         list_transform(r.season, lambda v, k: CASE WHEN k = (s.t - 1) % 12 + 1
                        THEN r.g * (s.y - r.level) + (1 - r.g) * v ELSE v END),
         r.sse + (s.y - r.level - r.season[(s.t - 1) % 12 + 1]) * (s.y - r.level - r.season[(s.t - 1) % 12 + 1])
  FROM hr r JOIN hs s ON s.repo = r.repo AND s.t = r.t + 1),
hb AS (SELECT * FROM (
  SELECT r.*, s.n, s.ds AS last_ds, row_number() OVER (PARTITION BY r.repo ORDER BY r.sse, r.a, r.g) AS rn
  FROM hr r JOIN hs s ON s.repo = r.repo AND s.t = r.t AND s.t = s.n) WHERE rn = 1),
fc AS (
  SELECT repo, 'holt_winters' AS model, CAST(k AS INTEGER) AS step,
         CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds,
         level + season[(n - 1 + k) % 12 + 1] AS yhat, sqrt(sse / n) AS sg FROM hb, range(1, 13) h(k)"""
    if not ses:
        return hw + ")"
    return f"""
sg AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS alpha FROM range(1, 100) r(i)),
ss AS (SELECT * FROM (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) AS t,
                             count(*) OVER (PARTITION BY repo) AS n FROM {src}) WHERE n BETWEEN 6 AND 23),
sr AS (
  SELECT ss.repo, sg.alpha, ss.t, ss.y AS level, CAST(0 AS DOUBLE) AS sse FROM ss CROSS JOIN sg WHERE ss.t = 1
  UNION ALL
  SELECT r.repo, r.alpha, ss.t, r.alpha * ss.y + (CAST(1 AS DOUBLE) - r.alpha) * r.level,
         r.sse + (ss.y - r.level) * (ss.y - r.level)
  FROM sr r JOIN ss ON ss.repo = r.repo AND ss.t = r.t + 1),
sbest AS (SELECT * FROM (SELECT r.*, ss.n, ss.ds AS last_ds, row_number() OVER (PARTITION BY r.repo ORDER BY r.sse, r.alpha) AS rn
  FROM sr r JOIN ss ON ss.repo = r.repo AND ss.t = r.t AND ss.t = ss.n) WHERE rn = 1),""" + hw + """
  UNION ALL
  SELECT repo, 'ses', CAST(k AS INTEGER), CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE), level,
         sqrt(sse / greatest(n - 1, 1)) FROM sbest, range(1, 13) h(k))"""


_SMOOTH_OUT = f"""
SELECT repo, model, step, ds, round(yhat, 4) AS yhat, round(yhat - {Z80} * sg, 4) AS yhat_lower,
       round(yhat + {Z80} * sg, 4) AS yhat_upper FROM fc"""

ORACLE["hw_forecast"] = with_views("pulls", recursive=True) + f""",
{PULLS_MONTHLY},{_smoothing("pm", ses=False)}{_SMOOTH_OUT}"""

ORACLE["smoothing_forecast"] = with_views("releases", recursive=True) + f""",
{RELEASES_MONTHLY},{_smoothing("rm")}{_SMOOTH_OUT}"""

ORACLE["recent_releases_smoothing"] = with_views("releases", recursive=True) + f""",
{_recent("releases", "published_at", "rec")},
rm2 AS ({_monthly("rec", "published_at")}),{_smoothing("rm2")}{_SMOOTH_OUT}"""


# ------------------------------------------------- reports with forecasts
_POINTS = ("string_agg(CAST(ds AS VARCHAR) || ':' || CAST(CAST(round(yhat, 2) AS DECIMAL(18, 2)) AS VARCHAR), ',' ORDER BY ds)")

ORACLE["issue_report_full"] = with_views("issues", recursive=True) + f""",
{_ISSUE_REPORT},
im AS ({_monthly("iw", "created_at")}),{_smoothing("im")},
fx AS (SELECT repo, {_POINTS} AS t FROM fc GROUP BY repo),
facts AS (SELECT 'orders/' || o_orderpriority AS repo, count(*) AS stars,
                 count(*) FILTER (o_orderstatus = 'F') AS forks FROM orders GROUP BY ALL)
SELECT r.repo, coalesce(fa.stars, 0) AS stars, coalesce(fa.forks, 0) AS forks, fx.t AS statsmodels_forecast,
       {_ISSUE_REPORT_COLS}
{_ISSUE_REPORT_JOINS}
LEFT JOIN facts fa ON fa.repo = r.repo LEFT JOIN fx ON fx.repo = r.repo"""

ORACLE["metric_reports"] = _MONTHLY_STATUS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
el AS (SELECT m.* FROM m_all m JOIN st ON st.repo = m.repo AND st.metric = m.metric
       AND st.slot = 'lstm' AND st.status = 'ok'),
ex AS (SELECT repo, metric, ds, y, row_number() OVER (PARTITION BY repo, metric ORDER BY ds) - 1 AS idx,
              count(*) OVER (PARTITION BY repo, metric) AS n FROM el),
eh AS (SELECT *, row_number() OVER (PARTITION BY repo, metric
                                    ORDER BY md5(repo || '|' || CAST(idx AS VARCHAR) || '|42')) AS hr FROM ex),
ec AS (SELECT repo, metric, CASE WHEN count(*) > 1 THEN regr_slope(y, idx) ELSE 0 END AS slope,
              CASE WHEN count(*) > 1 THEN regr_intercept(y, idx) ELSE avg(y) END AS icpt
       FROM eh WHERE n < 2 OR hr > ceil(n * 0.2) GROUP BY repo, metric),
lt AS (SELECT repo, metric, {_POINTS} AS t FROM (
  SELECT eh.repo, eh.metric, eh.ds, ec.icpt + ec.slope * eh.idx AS yhat
  FROM eh JOIN ec ON ec.repo = eh.repo AND ec.metric = eh.metric) GROUP BY repo, metric),
sm AS (SELECT m.metric || '|' || m.repo AS repo, m.ds, m.y FROM m_all m JOIN ok ON ok.repo = m.repo AND ok.metric = m.metric),
{_smoothing("sm").lstrip()},
ft AS (SELECT repo, {_POINTS} AS t FROM fc GROUP BY repo),
rp AS (SELECT repo, metric, max(n_records) AS n_records, max(n_points) AS n_points,
              max(CASE WHEN slot = 'lstm' THEN status END) AS lstm_status,
              max(CASE WHEN slot = 'prophet' THEN status END) AS prophet_status,
              max(CASE WHEN slot = 'statsmodels' THEN status END) AS statsmodels_status FROM st GROUP BY repo, metric)
SELECT rp.*, lt.t AS lstm_forecast, ft.t AS statsmodels_forecast
FROM rp LEFT JOIN lt ON lt.repo = rp.repo AND lt.metric = rp.metric
LEFT JOIN ft ON ft.repo = rp.metric || '|' || rp.repo"""


# ------------------------------- the least-squares family at closed-form sizes
def _diffs(src: str) -> str:
    """Differences of ``src`` with two lags: d (repo, ds, y, dy), l (.., x1, x2)."""
    return f"""d AS (SELECT repo, ds, y, y - lag(y) OVER (PARTITION BY repo ORDER BY ds) AS dy FROM {src}),
l AS (SELECT repo, ds, dy, lag(dy, 1) OVER w AS x1, lag(dy, 2) OVER w AS x2
      FROM d WINDOW w AS (PARTITION BY repo ORDER BY ds)),
f AS (SELECT * FROM l WHERE dy IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"""


def _two(src: str, name: str, x1: str, x2: str, y: str, ridge: str = "0") -> str:
    """Least squares of y on (x1, x2): ``name`` (repo, n, p1, p2, sse) by Cramer's rule."""
    return f"""{name}_g AS (SELECT repo, count(*) AS n, sum({x1} * {x1}) AS a, sum({x1} * {x2}) AS b, sum({x2} * {x2}) AS c,
  sum({x1} * {y}) AS u, sum({x2} * {y}) AS v, sum({y} * {y}) AS yy FROM {src} GROUP BY repo),
{name}_s AS (SELECT *, ((c + {ridge}) * u - b * v) / ((a + {ridge}) * (c + {ridge}) - b * b) AS p1,
  ((a + {ridge}) * v - b * u) / ((a + {ridge}) * (c + {ridge}) - b * b) AS p2 FROM {name}_g),
{name} AS (SELECT repo, n, p1, p2,
  greatest(yy - 2 * (p1 * u + p2 * v) + p1 * p1 * a + 2 * p1 * p2 * b + p2 * p2 * c, 0) AS sse FROM {name}_s)"""


def _path(model: str) -> str:
    return f"""SELECT repo, '{model}' AS model, step, CAST(last_ds + to_months(step) AS DATE) AS ds, round(level, 4) AS yhat,
       round(level - {Z80} * sg * sqrt(step), 4) AS yhat_lower, round(level + {Z80} * sg * sqrt(step), 4) AS yhat_upper
FROM rec"""


ORACLE["ar2_forecast"] = with_views("commits", recursive=True) + f""",
{COMMITS_MONTHLY},
{_diffs("cm")},
{_two("f", "fit", "x1", "x2", "dy")},
lst AS (SELECT repo, max(ds) AS last_ds, arg_max(y, ds) AS y, arg_max(dy, ds) AS d1, arg_max(x1, ds) AS d2
        FROM (SELECT l.*, d.y FROM l JOIN d ON d.repo = l.repo AND d.ds = l.ds) GROUP BY repo),
rec AS (
  SELECT repo, 1 AS step, p1, p2, sqrt(sse / greatest(n - 2, 1)) AS sg, last_ds, p1 * d1 + p2 * d2 AS e1, d1 AS e2,
         y + p1 * d1 + p2 * d2 AS level FROM fit JOIN lst USING (repo)
  UNION ALL
  SELECT repo, step + 1, p1, p2, sg, last_ds, p1 * e1 + p2 * e2, e1, level + p1 * e1 + p2 * e2 FROM rec WHERE step < 12)
{_path("ar2")}"""

ORACLE["arma_short_forecast"] = with_views("pulls", recursive=True) + f""",
{PULLS_MONTHLY},
{_diffs("pm")},
{_two("f", "long", "x1", "x2", "dy")},
res AS (SELECT f.repo, f.ds, f.dy - long.p1 * f.x1 - long.p2 * f.x2 AS e FROM f JOIN long USING (repo)),
de AS (SELECT d.repo, d.ds, d.dy, lag(d.dy) OVER w AS dy1, lag(res.e) OVER w AS e1
       FROM (SELECT * FROM d WHERE dy IS NOT NULL) d LEFT JOIN res ON res.repo = d.repo AND res.ds = d.ds
       WINDOW w AS (PARTITION BY d.repo ORDER BY d.ds)),
f2 AS (SELECT * FROM de WHERE dy1 IS NOT NULL AND e1 IS NOT NULL),
{_two("f2", "raw", "dy1", "e1", "dy", "1e-9")},
fit AS (SELECT repo, n, sse, greatest(-0.99, least(0.99, p1)) AS p1,
               greatest(-0.99, least(0.99, CASE WHEN abs(p2) > 1 THEN 1 / p2 ELSE p2 END)) AS p2 FROM raw),
nd AS (SELECT repo, ds, dy, row_number() OVER (PARTITION BY repo ORDER BY ds) AS t FROM d WHERE dy IS NOT NULL),
run AS (
  SELECT nd.repo, nd.t, nd.dy AS e, nd.dy FROM nd WHERE nd.t = 1
  UNION ALL
  SELECT nd.repo, nd.t, nd.dy - fit.p1 * run.dy - fit.p2 * run.e, nd.dy
  FROM run JOIN nd ON nd.repo = run.repo AND nd.t = run.t + 1 JOIN fit ON fit.repo = run.repo),
lst AS (SELECT repo, max(ds) AS last_ds, arg_max(y, ds) AS y FROM d GROUP BY repo),
el AS (SELECT repo, arg_max(e, t) AS e, arg_max(dy, t) AS dy FROM run GROUP BY repo),
rec AS (
  SELECT repo, 1 AS step, p1, sqrt(sse / greatest(n - 2, 1)) AS sg, last_ds, p1 * dy + p2 * e AS dd,
         y + p1 * dy + p2 * e AS level FROM fit JOIN lst USING (repo) JOIN el USING (repo)
  UNION ALL
  SELECT repo, step + 1, p1, sg, last_ds, p1 * dd, level + p1 * dd FROM rec WHERE step < 12)
{_path("arma")}"""

ORACLE["lookback1_forecast"] = with_views("pulls") + f""",
{PULLS_DAILY_FILLED},
sp AS (SELECT repo, ds, y, CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx,
         count(*) OVER (PARTITION BY repo) AS n FROM pdf)),
mm AS (SELECT repo, min(y) AS lo, max(y) AS hi FROM sp WHERE split = 'train' GROUP BY repo),
sc AS (SELECT sp.*, lo, hi, (y - lo) / (hi - lo) AS ys, CAST(1 AS DOUBLE) AS one FROM sp JOIN mm USING (repo)),
lb AS (SELECT * FROM (SELECT *, lag(ys) OVER (PARTITION BY repo, split ORDER BY ds) AS x FROM sc) WHERE x IS NOT NULL),
tr AS (SELECT * FROM lb WHERE split = 'train'),
{_two("tr", "fit", "one", "x", "ys", "1e-3")}
SELECT repo, 'lookback_per_series' AS model, split AS segment, ds, y, round((p1 + p2 * x) * (hi - lo) + lo, 4) AS yhat
FROM lb JOIN fit USING (repo)"""

ORACLE["forecast_tail"] = with_views("releases", recursive=True) + f""",
{RELEASES_MONTHLY},{_smoothing("rm")}
SELECT repo, model, ds, round(yhat, 4) AS yhat FROM fc WHERE step > 9"""


# ------------------------------------------------------- order search, F11, F10, E3, R3 to R5
def _kpss(z: str, name: str) -> str:
    """KPSS level statistic of ``z`` (repo, t from 0, v): ``name`` (repo, n, kpss)."""
    return f"""{name}_e AS (SELECT repo, t, v - avg(v) OVER (PARTITION BY repo) AS e, count(*) OVER (PARTITION BY repo) AS n,
  CAST(floor(4 * pow(count(*) OVER (PARTITION BY repo) / CAST(100 AS DOUBLE), CAST(0.25 AS DOUBLE))) AS INTEGER) AS lags FROM {z}),
{name}_c AS (SELECT repo, t, sum(e) OVER (PARTITION BY repo ORDER BY t) AS c FROM {name}_e),
{name}_s AS (SELECT repo, sum(c * c) AS ss FROM {name}_c GROUP BY repo),
{name}_g AS (SELECT repo, any_value(n) AS n, sum(e * e) AS g0 FROM {name}_e GROUP BY repo),
{name}_k AS (SELECT a.repo, sum(2 * (1 - (a.t - b.t) / CAST(a.lags + 1 AS DOUBLE)) * a.e * b.e) AS gk
  FROM {name}_e a JOIN {name}_e b ON b.repo = a.repo AND a.t > b.t AND a.t - b.t <= a.lags GROUP BY a.repo),
{name} AS (SELECT g.repo, g.n, ss / (CAST(g.n AS DOUBLE) * (g0 + coalesce(gk, 0))) AS kpss
  FROM {name}_g g JOIN {name}_s s ON s.repo = g.repo LEFT JOIN {name}_k k ON k.repo = g.repo)"""


ORACLE["differencing_order"] = with_views("pulls") + f""",
{PULLS_MONTHLY},
z0 AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS t, y AS v FROM pm),
z1 AS (SELECT * FROM (SELECT repo, t, v - lag(v) OVER (PARTITION BY repo ORDER BY t) AS v FROM z0) WHERE v IS NOT NULL),
z2 AS (SELECT * FROM (SELECT repo, t, v - lag(v) OVER (PARTITION BY repo ORDER BY t) AS v FROM z1) WHERE v IS NOT NULL),
{_kpss("z0", "k0")}, {_kpss("z1", "k1")}, {_kpss("z2", "k2")}
SELECT k0.repo, round(k0.kpss, 4) AS kpss0, round(k1.kpss, 4) AS kpss1, round(k2.kpss, 4) AS kpss2,
       CAST(CASE WHEN k0.kpss <= 0.463 OR k1.n < 4 THEN 0 WHEN k1.kpss <= 0.463 OR k2.n < 4 THEN 1 ELSE 2 END AS INTEGER) AS d
FROM k0 JOIN k1 USING (repo) JOIN k2 USING (repo)"""

ORACLE["lookback1_training_curve"] = ORACLE["lookback1_forecast"].split("tr AS (")[0].replace("WITH ", "WITH RECURSIVE ", 1) + """
g AS (SELECT repo, count(*) FILTER (split = 'train') AS n, sum(x) FILTER (split = 'train') AS sx,
             sum(x * x) FILTER (split = 'train') AS sxx, sum(ys) FILTER (split = 'train') AS sy,
             sum(x * ys) FILTER (split = 'train') AS sxy, sum(ys * ys) FILTER (split = 'train') AS syy,
             count(*) FILTER (split = 'test') AS m, sum(x) FILTER (split = 'test') AS tx, sum(x * x) FILTER (split = 'test') AS txx,
             sum(ys) FILTER (split = 'test') AS ty, sum(x * ys) FILTER (split = 'test') AS txy,
             sum(ys * ys) FILTER (split = 'test') AS tyy FROM lb GROUP BY repo),
w AS (SELECT repo, 1 AS epoch, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM g
      UNION ALL
      SELECT w.repo, epoch + 1, a - (n * a + sx * b - sy) / (n + sxx), b - (sx * a + sxx * b - sxy) / (n + sxx)
      FROM w JOIN g ON g.repo = w.repo WHERE epoch < 20),
l AS (SELECT w.repo, epoch, (syy - 2 * (a * sy + b * sxy) + a * a * n + 2 * a * b * sx + b * b * sxx) / n AS train_loss,
             (tyy - 2 * (a * ty + b * txy) + a * a * m + 2 * a * b * tx + b * b * txx) / m AS val_loss
      FROM w JOIN g ON g.repo = w.repo),
lo AS (SELECT *, arg_min(epoch, val_loss) OVER (PARTITION BY repo ORDER BY epoch) AS low FROM l),
en AS (SELECT repo, min(epoch) AS last FROM lo WHERE epoch - low >= 10 GROUP BY repo),
cut AS (SELECT lo.*, en.last FROM lo LEFT JOIN en ON en.repo = lo.repo WHERE en.last IS NULL OR epoch <= en.last)
SELECT repo, epoch, round(train_loss, 4) AS train_loss, round(val_loss, 4) AS val_loss,
       epoch = last_value(low) OVER (PARTITION BY repo ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
       coalesce(epoch = last, false) AS stopped FROM cut"""


def _det(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions, by its first row."""
    if len(m) == 1:
        return m[0][0]
    terms = (f"{'-' if j % 2 else '+'} ({m[0][j]}) * ({_det([r[:j] + r[j + 1:] for r in m[1:]])})" for j in range(len(m)))
    return "(" + " ".join(terms).lstrip("+ ") + ")"


def _cramer(g: list[list[str]], b: list[str]) -> list[str]:
    whole = _det(g)
    return [f"{_det([r[:j] + [b[i]] + r[j + 1:] for i, r in enumerate(g)])} / {whole}" for j in range(len(b))]


_KNOT_G = [[f"g{min(i, j)}{max(i, j)}" + ((" + 1e-9 * n" if i < 2 else " + (1e-9 + c) * n") if i == j else "") for j in range(4)]
           for i in range(4)]
_KNOT_LOO = [[f"{_KNOT_G[i][j]} - f{i} * f{j}" for j in range(4)] for i in range(4)]
_KNOT_FIT = _cramer(_KNOT_G, [f"b{i}" for i in range(4)])
_KNOT_OUT = _cramer(_KNOT_LOO, [f"b{i} - f{i} * y" for i in range(4)])

# every point is left out and the four coefficients solved again, by Cramer's rule
ORACLE["smooth_trend_two_knots"] = with_views("pulls") + f""",
{PULLS_MONTHLY},
ix AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY repo) AS n FROM pm),
fx AS (SELECT *, CAST(1 AS DOUBLE) AS f0, idx / CAST(greatest(n - 1, 1) AS DOUBLE) AS f1,
              greatest(idx / CAST(greatest(n - 1, 1) AS DOUBLE) - CAST(1 AS DOUBLE) / 3, 0) AS f2,
              greatest(idx / CAST(greatest(n - 1, 1) AS DOUBLE) - CAST(2 AS DOUBLE) / 3, 0) AS f3 FROM ix),
gx AS (SELECT repo, {", ".join(f"sum(f{i} * f{j}) AS g{i}{j}" for i in range(4) for j in range(i, 4))},
              {", ".join(f"sum(f{i} * y) AS b{i}" for i in range(4))} FROM fx GROUP BY repo),
pc AS (SELECT CAST(c AS DOUBLE) AS c FROM (VALUES (0.0001), (0.01), (1)) v(c)),
ea AS (SELECT fx.repo, ds, idx, y, c, {" + ".join(f"f{j} * ({_KNOT_FIT[j]})" for j in range(4))} AS yhat,
              y - ({" + ".join(f"f{j} * ({_KNOT_OUT[j]})" for j in range(4))}) AS e
       FROM fx JOIN gx ON gx.repo = fx.repo CROSS JOIN pc),
sc AS (SELECT repo, c, avg(e * e) AS loo FROM ea GROUP BY repo, c),
bc AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY repo ORDER BY loo, c DESC) = 1)
SELECT ea.repo, ds, idx, y, round(yhat, 4) AS yhat, bc.c AS penalty, round(loo, 4) AS loo
FROM ea JOIN bc ON bc.repo = ea.repo AND bc.c = ea.c"""

ORACLE["rolling_comparison_plain"] = with_views("pulls", recursive=True) + f""",
{PULLS_MONTHLY},
s AS (SELECT repo, ds, y, row_number() OVER (PARTITION BY repo ORDER BY ds) AS t, count(*) OVER (PARTITION BY repo) AS n FROM pm),
o AS (SELECT DISTINCT repo, n - (7 - j) * 3 AS o FROM s, range(1, 7) r(j) WHERE n - (7 - j) * 3 >= 24),
lt AS (SELECT o.repo, o.o, regr_slope(y, t - 1) AS slope, regr_intercept(y, t - 1) AS icpt
       FROM o JOIN s ON s.repo = o.repo AND s.t <= o.o GROUP BY o.repo, o.o),
grid AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS alpha FROM range(1, 100) r(i)),
rec AS (
  SELECT s.repo, g.alpha, s.t, s.y AS level, CAST(0 AS DOUBLE) AS sse FROM s CROSS JOIN grid g WHERE s.t = 1
  UNION ALL
  SELECT r.repo, r.alpha, s.t, r.alpha * s.y + (CAST(1 AS DOUBLE) - r.alpha) * r.level,
         r.sse + (s.y - r.level) * (s.y - r.level) FROM rec r JOIN s ON s.repo = r.repo AND s.t = r.t + 1),
se AS (SELECT r.repo, o.o, r.level FROM rec r JOIN o ON o.repo = r.repo AND r.t = o.o
       QUALIFY row_number() OVER (PARTITION BY r.repo, o.o ORDER BY sse, alpha) = 1),
fc AS (SELECT s.repo, 'index_trend' AS model, s.y, icpt + slope * (s.t - 1) AS yhat
       FROM lt JOIN s ON s.repo = lt.repo AND s.t > lt.o AND s.t <= lt.o + 3
       UNION ALL
       SELECT s.repo, 'ses', s.y, se.level FROM se JOIN s ON s.repo = se.repo AND s.t > se.o AND s.t <= se.o + 3),
m AS (SELECT repo, model, count(*) AS n, avg((y - yhat) * (y - yhat)) AS mse FROM fc GROUP BY repo, model)
SELECT repo, model, n, round(mse, 4) AS mse, row_number() OVER (PARTITION BY repo ORDER BY mse, model) AS rank FROM m"""

ORACLE["published_forecasts"] = ORACLE["pulls_ses_forecast"].replace(
    "SELECT repo, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, round(alpha, 4) AS alpha, round(level, 4) AS yhat",
    "SELECT repo, 'pulls' AS metric, 'ses' AS model, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, "
    "round(level, 4) AS yhat")

ORACLE["issue_month_maps"] = with_views("issues", recursive=True) + f""",
{_WINDOWS},
ev AS (SELECT repo, 'created' AS event, strftime(created_at, '%Y-%m') AS month FROM iw WHERE created_at IS NOT NULL
       UNION ALL SELECT repo, 'closed', strftime(closed_at, '%Y-%m') FROM iw WHERE closed_at IS NOT NULL),
c AS (SELECT repo, event, month, count(*) AS n FROM ev GROUP BY ALL)
SELECT *, CAST(count(*) OVER (PARTITION BY repo, event) AS INTEGER) AS months FROM c"""

ORACLE["units_synthetic_months"] = f"""
WITH u AS (SELECT 'units/' || l_returnflag AS repo, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT repo, n, date_diff('day', DATE '1970-01-01', {AS_OF_SQL}) - n AS lo,
             date_diff('day', DATE '1970-01-01', {AS_OF_SQL}) - 1 AS hi FROM u),
m AS (SELECT make_date(CAST(1 + i // 12 AS INTEGER), CAST(1 + i % 12 AS INTEGER), 1) AS ds FROM range(0, 24012) r(i)),
d AS (SELECT ds, date_diff('day', DATE '1970-01-01', ds) AS a, date_diff('day', DATE '1970-01-01', last_day(ds)) AS z FROM m),
x AS (SELECT repo, ds, least(z, hi) - greatest(a, lo) + 1 AS n FROM b JOIN d ON z >= lo AND a <= hi)
SELECT repo, ds, CAST(n AS DOUBLE) AS y, n, 'ok' AS status FROM x
UNION ALL
SELECT repo, NULL, CAST(-719162 - lo AS DOUBLE), -719162 - lo, 'before_calendar' FROM b WHERE lo < -719162"""

# ------------------------------------------------------------ the dashboard's tables
ORACLE["dashboard_bars"] = with_views("issues", recursive=True) + f""",
{_WINDOWS},
ev AS (SELECT repo, 'created' AS event, strftime(created_at, '%Y-%m') AS month FROM iw WHERE created_at IS NOT NULL
       UNION ALL SELECT repo, 'closed', strftime(closed_at, '%Y-%m') FROM iw WHERE closed_at IS NOT NULL)
SELECT repo, event, month, count(*) AS n, row_number() OVER (PARTITION BY repo, event ORDER BY month) AS position
FROM ev GROUP BY repo, event, month"""

ORACLE["dashboard_insights"] = with_views("issues", recursive=True) + f""",
{_ISSUE_REPORT}
SELECT r.repo, a.v AS max_created_day_of_week, b.v AS max_closed_day_of_week, c.v AS max_closed_month_of_year
{_ISSUE_REPORT_JOINS}"""

_DASH = ORACLE["metric_reports"].split("lt AS (SELECT repo, metric,")[0]
ORACLE["dashboard_charts"] = _DASH + f"""
sm AS (SELECT m.metric || '|' || m.repo AS repo, m.ds, m.y FROM m_all m JOIN ok ON ok.repo = m.repo AND ok.metric = m.metric),
{_smoothing("sm").lstrip()}
SELECT eh.repo, eh.metric, 'lstm' AS slot, 'index_trend' AS model, eh.ds, eh.y, round(ec.icpt + ec.slope * eh.idx, 4) AS yhat
FROM eh JOIN ec ON ec.repo = eh.repo AND ec.metric = eh.metric
UNION ALL
SELECT split_part(repo, '|', 2), split_part(repo, '|', 1), 'statsmodels', model, ds, NULL, round(yhat, 4) FROM fc"""

# gates as in status_report; of the series that pass the third slot's gate, those without any
# change are degenerate for AR(5) and those with an overflow have failed
ORACLE["status_report_fits"] = """
WITH li AS (SELECT l_returnflag AS flag, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, count(*) AS n,
                   sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT 'lineitem/' || flag AS repo, ds, CAST(n AS DOUBLE) AS y, n FROM li
      UNION ALL SELECT flag, ds, CAST(n AS DOUBLE), n FROM li
      UNION ALL SELECT 'train/' || flag, ds, CAST(1 AS DOUBLE), n FROM li
      UNION ALL SELECT 'overflow/' || flag, ds, CASE WHEN v > 1000 THEN CAST('Infinity' AS DOUBLE) ELSE exp(CAST(v AS DOUBLE)) END, n FROM li
      UNION ALL SELECT 'young/' || flag, ds, CAST(n AS DOUBLE), n FROM (
        SELECT *, row_number() OVER (PARTITION BY flag ORDER BY ds) AS t FROM li) WHERE t <= 5),
c AS (SELECT repo, sum(n) AS n_records, count(*) AS n_points,
             max(CASE WHEN isinf(y) THEN 1 ELSE 0 END) AS bad, max(y) = min(y) AS flat FROM s GROUP BY repo),
k AS (SELECT repo FROM s UNION SELECT 'nation/' || n_name FROM nation),
slots(slot, estimator, least) AS (VALUES ('lstm', 'index_trend', 0), ('prophet', 'additive', 0), ('statsmodels', 'ar5', 12))
SELECT k.repo, 'commits' AS metric, slot, estimator, CAST(coalesce(n_records, 0) AS BIGINT) AS n_records,
       coalesce(n_points, 0) AS n_points,
       CASE WHEN len(string_split(k.repo, '/')) <> 2 THEN 'invalid_repo' WHEN c.repo IS NULL THEN 'no_data'
            WHEN n_points < least THEN 'not_enough_data' WHEN slot = 'statsmodels' AND bad = 1 THEN 'failed'
            WHEN slot = 'statsmodels' AND flat THEN 'degenerate' ELSE 'ok' END AS status
FROM k LEFT JOIN c ON c.repo = k.repo, slots
UNION ALL
SELECT DISTINCT 'orders/' || o_orderpriority, 'pulls', slot, CASE slot WHEN 'statsmodels' THEN 'smoothing' ELSE estimator END, 0, 0,
       'no_column' FROM orders, slots"""
