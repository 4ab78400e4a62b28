"""Building blocks of the oracle SQL: named common table expressions and their dependencies."""

from __future__ import annotations

from .requests_view import PREFIXES, REQUESTS_SQL, TIMEOUT

ASSETS = r"\.(css|js|mjs|png|jpg|jpeg|gif|svg|ico|webp|woff|woff2|ttf|map|json|xml|txt|pdf|zip|gz)$"
SUSPECT = (
    "python-requests|researchscraper|researchstealth|stealth-browser|hybridcrawler|browsernoise|scrapy|"
    "selenium|webdriver|playwright|puppeteer|aiohttp|httpclient|httpx|curl/|wget/|urllib|headless|"
    "phantomjs|go-http-client"
)
CATEGORY = "CASE WHEN trim({p}, '/') = '' THEN 'home' ELSE split_part(trim({p}, '/'), '/', 1) END"
METADATA = ["participant_id", "traffic_family", "collection_method", "automation_stack", "notes"]


def r6(expression: str) -> str:
    """Six decimals without a negative zero."""
    return f"(round({expression}, 6) + 0.0::DOUBLE)"


def session_ctes(prefix: str, where: str, min_length: int) -> dict[str, str]:
    """Numbered events of the sessions of the requests that satisfy ``where``."""
    category = CATEGORY.format(p="path")
    return {
        f"{prefix}_gaps": f"""
          SELECT *, {category} AS page_category,
            CASE WHEN timestamp - lag(timestamp) OVER w > {TIMEOUT}::DOUBLE THEN 1 ELSE 0 END AS is_new
          FROM requests WHERE {where}
          WINDOW w AS (PARTITION BY client_key ORDER BY timestamp, path, event_id)""",
        f"{prefix}_numbered": f"""
          SELECT *, CAST(sum(is_new) OVER (PARTITION BY client_key ORDER BY timestamp, path, event_id
              ROWS UNBOUNDED PRECEDING) AS INT) AS session_index
          FROM {prefix}_gaps""",
        f"{prefix}_seq": f"""
          SELECT *, 'sess_' || substr(sha1(client_key), 1, 12) || '_' || printf('%03d', session_index) AS session_id,
            row_number() OVER (PARTITION BY client_key, session_index ORDER BY timestamp, path, event_id) AS seq,
            count(*) OVER (PARTITION BY client_key, session_index) AS n_events
          FROM {prefix}_numbered""",
        prefix: f"""
          SELECT * EXCLUDE (referrer), referrer AS raw_referrer,
            coalesce(referrer, lag(path) OVER s) AS referrer,
            coalesce(greatest(0.0::DOUBLE, timestamp - lag(timestamp) OVER s), 0.0::DOUBLE) AS delta_t,
            lag(path) OVER s AS prev_path, lag(path, 2) OVER s AS prev2_path,
            lag(page_category) OVER s AS prev_category,
            last_value(user_agent IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user_agent
          FROM {prefix}_seq WHERE n_events >= {min_length}
          WINDOW s AS (PARTITION BY session_id ORDER BY seq)""",
    }


def summary_sql(source: str, label: str = "'unknown'", metadata: dict[str, str] | None = None) -> str:
    meta = {c: "NULL::VARCHAR" for c in METADATA}
    meta["participant_id"] = "max(participant_id) FILTER (seq = 1)"
    meta.update(metadata or {})
    return f"""
      SELECT session_id, {label} AS label,
        max(client_key) FILTER (seq = 1) AS client_key, max(ip) FILTER (seq = 1) AS ip,
        count(*) AS num_events, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp,
        max(timestamp) - min(timestamp) AS duration_seconds,
        count(DISTINCT path) AS unique_paths, count(DISTINCT path) / count(*)::DOUBLE AS unique_path_ratio,
        coalesce(sum(delta_t) FILTER (seq > 1) / (count(*) - 1), 0.0::DOUBLE) AS mean_delta_t,
        count(DISTINCT page_category) AS page_categories,
        max(path) FILTER (seq = 1) AS first_path,
        count(*) FILTER (referrer IS NOT NULL) / count(*)::DOUBLE AS referrer_present_ratio,
        count(*) FILTER (raw_referrer IS NOT NULL) / count(*)::DOUBLE AS raw_referrer_ratio,
        count(*) FILTER (NOT regexp_matches(lower(path), '{ASSETS}')) AS num_page_requests,
        count(*) FILTER (regexp_matches(lower(path), '{ASSETS}')) AS num_asset_requests,
        count(*) FILTER (regexp_matches(lower(path), '{ASSETS}')) / count(*)::DOUBLE AS asset_request_ratio,
        max(CASE WHEN regexp_matches(lower(path), '{ASSETS}') THEN 1.0 ELSE 0.0 END)::DOUBLE AS has_asset_requests,
        max(user_agent) FILTER (seq = 1) AS user_agent,
        {", ".join(f"{meta[c]} AS {c}" for c in METADATA)}
      FROM {source} GROUP BY session_id"""


CTES: dict[str, str] = {
    **session_ctes("ev", f"NOT regexp_matches(lower(path), '{ASSETS}')", 2),
    **session_ctes("allev", "true", 1),
    "manual": """
      SELECT DISTINCT 'client_id:' || user_id AS client_key,
        CASE WHEN user_id % 6 IN (0, 3, 4) THEN 'bot' ELSE 'human' END AS label,
        CASE WHEN user_id % 6 IN (1, 2) THEN 'panel' END AS collection_method
      FROM events WHERE user_id % 6 <> 5""",
    "summary": summary_sql("ev"),
    "all_summary": summary_sql("allev"),
    "weak": f"""
      SELECT s.* EXCLUDE (collection_method), coalesce(s.collection_method, m.collection_method) AS collection_method,
        m.label AS manual_label,
        coalesce(regexp_matches(lower(user_agent), '{SUSPECT}'), false) AS suspicious_user_agent,
        least(CASE WHEN coalesce(regexp_matches(lower(user_agent), '{SUSPECT}'), false) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END
          + CASE WHEN mean_delta_t <= 1.0 THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
          + CASE WHEN num_events >= 20 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
          + CASE WHEN unique_path_ratio >= 0.90::DOUBLE THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
          + CASE WHEN page_categories <= 2 AND num_events >= 10 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END,
          1.0::DOUBLE) AS weak_bot_score
      FROM summary s LEFT JOIN manual m USING (client_key)""",
    "labelled_summary": """
      SELECT *, CASE WHEN manual_label IS NOT NULL THEN manual_label
          WHEN suspicious_user_agent AND weak_bot_score >= 0.55::DOUBLE THEN 'bot'
          WHEN weak_bot_score >= 0.75::DOUBLE THEN 'bot'
          WHEN weak_bot_score <= 0.15::DOUBLE AND num_events >= 3 THEN 'human'
          ELSE 'unknown' END AS proposed_label
      FROM weak""",
    "lev": """
      SELECT e.* EXCLUDE (participant_id), coalesce(s.participant_id, e.participant_id) AS participant_id,
        s.proposed_label AS label, s.collection_method
      FROM ev e JOIN labelled_summary s USING (session_id)""",
    # graph of all kept sessions
    "edges": """
      SELECT source, target, count(*) AS weight FROM (
        SELECT prev_path AS source, path AS target FROM ev WHERE seq > 1
        UNION ALL
        SELECT referrer, path FROM ev WHERE referrer LIKE '/%' AND referrer <> path
      ) GROUP BY source, target""",
    "bfs": """
      SELECT '/' AS path, 0 AS d
      UNION
      SELECT e.target, b.d + 1 FROM bfs b JOIN edges e ON e.source = b.path WHERE b.d < 12""",
    "nodes": f"""
      SELECT p.path, {CATEGORY.format(p="p.path")} AS category, coalesce(d.depth, -1) AS depth,
        coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(o.n, 0) = 0 AS is_leaf
      FROM (SELECT source AS path FROM edges UNION SELECT target FROM edges UNION SELECT '/') p
      LEFT JOIN (SELECT target AS path, count(*) AS n FROM edges GROUP BY 1) i USING (path)
      LEFT JOIN (SELECT source AS path, count(*) AS n FROM edges GROUP BY 1) o USING (path)
      LEFT JOIN (SELECT path, min(d) AS depth FROM bfs GROUP BY 1) d USING (path)""",
    # graph of the earlier 60 % of sessions, against which all are measured
    "session_rank": """
      SELECT session_id, row_number() OVER (ORDER BY start_timestamp, session_id) AS rank,
        count(*) OVER () AS total FROM summary""",
    "early_ev": """
      SELECT * FROM ev WHERE session_id IN
        (SELECT session_id FROM session_rank WHERE rank <= greatest(1, floor(total * 0.6::DOUBLE)))""",
    "graded_ev": "SELECT *, 'unknown' AS label FROM ev",
    "early_edges": """
      SELECT DISTINCT source, target FROM (
        SELECT prev_path AS source, path AS target FROM early_ev WHERE seq > 1
        UNION ALL
        SELECT referrer, path FROM early_ev WHERE referrer LIKE '/%' AND referrer <> path)""",
    "early_bfs": """
      SELECT '/' AS path, 0 AS d
      UNION
      SELECT e.target, b.d + 1 FROM early_bfs b JOIN early_edges e ON e.source = b.path WHERE b.d < 12""",
    "early_nodes": """
      SELECT p.path, coalesce(d.depth, -1) AS depth, coalesce(o.n, 0) AS out_degree, coalesce(o.n, 0) = 0 AS is_leaf
      FROM (SELECT source AS path FROM early_edges UNION SELECT target FROM early_edges UNION SELECT '/') p
      LEFT JOIN (SELECT source AS path, count(*) AS n FROM early_edges GROUP BY 1) o USING (path)
      LEFT JOIN (SELECT path, min(d) AS depth FROM early_bfs GROUP BY 1) d USING (path)""",
    "step_pairs": "SELECT DISTINCT prev_path AS source, path AS target FROM ev WHERE seq > 1",
    "walk": """
      SELECT DISTINCT source AS origin, source AS node, 0 AS d FROM step_pairs
      UNION
      SELECT w.origin, e.target, w.d + 1 FROM walk w JOIN early_edges e ON e.source = w.node WHERE w.d < 12""",
    "step_hops": """
      SELECT p.source, p.target, CAST(coalesce(min(w.d), 999) AS INT) AS hops
      FROM step_pairs p LEFT JOIN walk w ON w.origin = p.source AND w.node = p.target
      GROUP BY p.source, p.target""",
}
RECURSIVE = {"bfs", "early_bfs", "walk"}


def feature_ctes(name: str, source: str, prefix_rule: str, nodes: str, hops: str | None) -> dict[str, str]:
    """Features of ``source`` events; ``prefix_rule`` lists the prefix lengths of an event."""
    hop = "CASE WHEN e.path = e.prev_path THEN 0 ELSE 1 END"
    hop_join = ""
    if hops:
        hop = "CASE WHEN e.path = e.prev_path THEN 0 ELSE coalesce(h.hops, 999) END"
        hop_join = f"LEFT JOIN {hops} h ON h.source = e.prev_path AND h.target = e.path"
    kinds = [
        ("node", "path", "NULL::VARCHAR", "true"), ("cat", "page_category", "NULL::VARCHAR", "true"),
        ("trans", "prev_path", "path", "seq > 1"), ("cattrans", "prev_category", "page_category", "seq > 1"),
    ]
    symbols = " UNION ALL ".join(
        f"SELECT session_id, prefix_len, '{k}' AS kind, {a} AS a, {b} AS b, seq <= h AS early FROM {name}_in WHERE {cond}"
        for k, a, b, cond in kinds
    )
    pick = lambda k, c: f"max({c}) FILTER (kind = '{k}')"
    norm = lambda k, e, d: f"CASE WHEN {k}_{d} > 1 THEN {k}_{e} / log2({k}_{d}) ELSE 0.0::DOUBLE END"
    picked = ", ".join(
        f"{pick(k, c)} AS {k}_{c}" for k in ("node", "cat", "trans", "cattrans") for c in ("h1", "h0", "p2", "d1", "d0")
    )
    names = {"node": "node", "cat": "category", "trans": "transition", "cattrans": "category_transition"}
    entropy = ", ".join(
        f"{k}_h1 AS {n}_entropy, {norm(k, 'h1', 'd1')} AS normalized_{n}_entropy, "
        f"{k}_h1 - {k}_h0 AS {n}_entropy_delta, "
        f"{norm(k, 'h1', 'd1')} - {norm(k, 'h0', 'd0')} AS normalized_{n}_entropy_delta"
        for k, n in names.items()
    )
    return {
        f"{name}_in": f"""
          SELECT e.*, coalesce(g.depth, -1) AS depth, coalesce(g.out_degree, 0) AS out_degree,
            coalesce(g.is_leaf, false) AS is_leaf, CASE WHEN e.seq > 1 THEN {hop} END AS hops,
            greatest(2, e.prefix_len // 2) AS h
          FROM (SELECT *, unnest({prefix_rule}) AS prefix_len FROM {source}) e
          LEFT JOIN {nodes} g ON g.path = e.path {hop_join}""",
        f"{name}_sym": f"""
          SELECT session_id, prefix_len, kind, a, b, count(*) AS c, count(*) FILTER (early) AS c0
          FROM ({symbols}) GROUP BY ALL""",
        f"{name}_tot": f"""
          SELECT *, sum(c) OVER k::DOUBLE AS t, sum(c0) OVER k::DOUBLE AS t0 FROM {name}_sym
          WINDOW k AS (PARTITION BY session_id, prefix_len, kind)""",
        f"{name}_ent": f"""
          SELECT session_id, prefix_len, kind,
            0.0::DOUBLE - sum(c / t * log2(c / t)) AS h1,
            0.0::DOUBLE - sum(CASE WHEN c0 > 0 THEN c0 / t0 * log2(c0 / t0) ELSE 0.0::DOUBLE END) AS h0,
            sum((c / t) * (c / t)) AS p2, count(*) AS d1, count(*) FILTER (c0 > 0) AS d0
          FROM {name}_tot GROUP BY ALL""",
        f"{name}_src": f"""
          SELECT session_id, prefix_len, a, sum(c)::DOUBLE AS m, count(*) AS d, sum(c * log2(c)) AS s
          FROM {name}_sym WHERE kind = 'trans' GROUP BY ALL""",
        f"{name}_branch": f"""
          SELECT session_id, prefix_len, avg(CASE WHEN d <= 1 THEN 0.0::DOUBLE ELSE (log2(m) - s / m)
            / log2(CASE WHEN out_degree >= 2 THEN out_degree ELSE d END) END) AS lbe
          FROM {name}_src LEFT JOIN {nodes} g ON g.path = a GROUP BY ALL""",
        f"{name}_base": f"""
          SELECT session_id, prefix_len, max(label) AS label, count(*)::DOUBLE AS n, count(*)::DOUBLE - 1 AS m,
            max(h)::DOUBLE AS h,
            count(*) FILTER (seq > 2 AND path = prev2_path) AS backtracks,
            count(*) FILTER (seq > 1 AND path = prev_path) AS loops,
            coalesce(sum(depth) FILTER (depth >= 0) / count(*) FILTER (depth >= 0)::DOUBLE, 0.0::DOUBLE) AS mean_depth,
            count(*) FILTER (is_leaf) AS leaves, sum(out_degree) AS degrees, sum(hops) AS hop_sum,
            count(*) FILTER (hops >= 3) AS far, sum(delta_t) FILTER (seq > 1) AS delta_sum,
            stddev_pop(delta_t) FILTER (seq > 1) AS sd, count(*) FILTER (seq > 1 AND delta_t <= 1.0) AS fast,
            coalesce(count(*) FILTER (status_code >= 400) / nullif(count(status_code), 0)::DOUBLE, 0.0::DOUBLE) AS error_rate,
            count(user_agent) AS agents,
            count(*) FILTER (seq > 1 AND user_agent <> prev_user_agent) AS agent_switches,
            count(*) FILTER (seq > 1 AND page_category <> prev_category) AS category_switches
          FROM {name}_in GROUP BY session_id, prefix_len""",
        f"{name}_wide": f"""
          SELECT b.*, e.* EXCLUDE (session_id, prefix_len), r.lbe FROM {name}_base b
          JOIN (SELECT session_id, prefix_len, {picked} FROM {name}_ent GROUP BY session_id, prefix_len) e
            USING (session_id, prefix_len)
          JOIN {name}_branch r USING (session_id, prefix_len)""",
        f"{name}_raw": f"""
          SELECT *, n AS session_length_so_far, node_d1::DOUBLE AS unique_nodes, node_d1 / n AS unique_node_ratio,
            1.0::DOUBLE - node_d1 / n AS revisit_ratio, (n - node_d1) / n AS repeated_path_ratio,
            (m - trans_d1) / m AS repeated_transition_ratio, backtracks::DOUBLE AS backtrack_count,
            loops / m AS self_loop_ratio, leaves / n AS leaf_visit_ratio, degrees / n AS out_degree_mean,
            hop_sum / m AS mean_hop_distance, far / m AS far_jump_ratio, delta_sum / m AS mean_delta_t,
            sd AS std_delta_t,
            CASE WHEN m >= 2 AND sd + delta_sum / m <> 0 THEN (sd - delta_sum / m) / (sd + delta_sum / m)
              ELSE 0.0::DOUBLE END AS burstiness,
            fast / m AS low_latency_ratio,
            CASE WHEN agents >= 2 THEN agent_switches / (agents - 1)::DOUBLE ELSE 0.0::DOUBLE END AS user_agent_switch_rate,
            category_switches / m AS category_switch_rate, {entropy},
            lbe AS local_branching_entropy, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - lbe)) AS branching_concentration,
            node_p2 AS coverage_concentration, trans_p2 AS transition_concentration, cat_p2 AS category_concentration,
            greatest(0.0::DOUBLE, (1.0::DOUBLE - node_d1 / n) - (1.0::DOUBLE - node_d0 / h)) AS revisit_growth,
            CASE WHEN n > h THEN (node_h1 - node_h0) / (n - h) ELSE 0.0::DOUBLE END AS entropy_slope,
            CASE WHEN n > h THEN (trans_h1 - trans_h0) / (n - h) ELSE 0.0::DOUBLE END AS transition_entropy_slope,
            CASE WHEN n > h THEN (cattrans_h1 - cattrans_h0) / (n - h) ELSE 0.0::DOUBLE END AS category_transition_entropy_slope
          FROM {name}_wide""",
        name: f"""
          SELECT *,
            greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.30::DOUBLE * normalized_transition_entropy
              + 0.20::DOUBLE * normalized_category_entropy + 0.15::DOUBLE * (1.0::DOUBLE - revisit_ratio)
              + 0.15::DOUBLE * category_switch_rate + 0.10::DOUBLE * far_jump_ratio
              + 0.10::DOUBLE * (1.0::DOUBLE - abs(burstiness)))) AS navigation_entropy_score,
            greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.22::DOUBLE * normalized_transition_entropy
              + 0.18::DOUBLE * normalized_node_entropy + 0.18::DOUBLE * normalized_category_transition_entropy
              + 0.15::DOUBLE * local_branching_entropy
              + 0.12::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + normalized_transition_entropy_delta))
              + 0.08::DOUBLE * (1.0::DOUBLE - coverage_concentration)
              + 0.07::DOUBLE * (1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, revisit_growth))))) AS navigation_entropy_score_v2
          FROM {name}_raw""",
    }


_PREFIX_RULE = f"list_filter({PREFIXES}, lambda p: p >= seq AND p <= n_events)"
CTES.update(feature_ctes("pf", "lev", _PREFIX_RULE, "nodes", None))
CTES.update(feature_ctes("ff", "lev", "[n_events]", "nodes", None))
CTES.update(feature_ctes("gf", "graded_ev", _PREFIX_RULE, "early_nodes", "step_hops"))
CTES.update(feature_ctes("of", "lev", "range(greatest(seq, 2), n_events + 1)", "nodes", None))


def query(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` with the common table expressions it needs, in dependency order."""
    import re

    available = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for word in re.findall(r"[A-Za-z_0-9]+", text):
            if word in available and word != own and word not in ordered:
                visit(available[word], word)
                ordered.append(word)

    visit(select, None)
    parts = [f"{name} AS ({available[name]})" for name in ordered]
    used = " ".join([select, *parts])
    if re.search(r"\brequests\b", used):
        parts.insert(0, REQUESTS_SQL)
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select
