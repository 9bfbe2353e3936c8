"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import collocations as C
from . import link_graph as L


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def link_graph_sql() -> str:
    """``op6_link_graph``: rules, host edges and both walks, each a recursive CTE."""
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{L.UPPER}', '{L.LOWER}')"
    fits = lambda r: (f"((host = {_q(r.host)} OR ends_with(host, {_q('.' + r.host)})) "  # noqa: E731
                      f"AND starts_with(path, {_q(r.path)}))")
    ranked = sorted(L.RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN {value(r)}" for r in ranked) + " END"
    ctes = [
        f"p AS MATERIALIZED (SELECT page_id, html, {host('coalesce(url, chr(32))')} AS host, "
        "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"r AS MATERIALIZED (SELECT page_id, host, path, {case(lambda r: _q(r.name))} AS rule, "
        f"{case(lambda r: str(r.allow).lower())} AS allow FROM p)",
        f"links AS (SELECT host AS a, unnest(regexp_extract_all(html, {_q(L.LINK)}, 1)) AS t FROM p WHERE html IS NOT NULL)",
        f"pairs AS (SELECT a, {host('''CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END''')} AS b FROM links)",
        "edges AS MATERIALIZED (SELECT a, b, count(*) AS n FROM pairs WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b)",
        "seeds AS (SELECT host, 2 * count(*) FILTER (allow) >= count(*) AS good, "
        "2 * count(*) FILTER (NOT allow) >= count(*) AS bad FROM r WHERE host <> '' GROUP BY host)",
        "hosts AS MATERIALIZED (SELECT host, bool_or(good) AS good, bool_or(bad) AS bad FROM (SELECT * FROM seeds "
        "UNION ALL SELECT a, false, false FROM edges UNION ALL SELECT b, false, false FROM edges) GROUP BY host)",
    ]
    for name, seed, a, b in (("t", "good", "a", "b"), ("d", "bad", "b", "a")):
        ctes.append(f"{name}_step AS MATERIALIZED (SELECT {a} AS host, {b} AS nxt, n / sum(n) OVER (PARTITION BY {a}) AS p FROM edges)")
        ctes.append(f"{name}0 AS MATERIALIZED (SELECT host, 1.0::DOUBLE / (SELECT count(*) FROM hosts WHERE {seed}) AS m "
                    f"FROM hosts WHERE {seed})")
        # turns until no mass that can be left matters, as in the operator: it is at most DAMPING ** k after k turns
        turns = f"(SELECT ceil(ln({L.REST * L.MARGIN} / greatest(count(*), 1)) / ln({L.DAMPING})) FROM hosts)"
        ctes.append(f"{name}_walk(k, host, m) AS (SELECT 0, host, m FROM {name}0 UNION ALL SELECT k + 1, nxt, sum(m * p * {L.DAMPING}) "
                    f"FROM {name}_walk JOIN {name}_step USING (host) WHERE k < {turns} GROUP BY k, nxt)")
        ctes.append(f"{name}_score AS (SELECT host, sum(m) * {1 - L.DAMPING} AS s FROM {name}_walk GROUP BY host)")
    ctes.append("blocked AS (SELECT h.host FROM hosts h LEFT JOIN t_score t ON t.host = h.host LEFT JOIN d_score d ON d.host = h.host "
                f"WHERE coalesce(d.s, 0) - coalesce(t.s, 0) > {L.MARGIN} / (SELECT count(*) FROM hosts))")
    return ("WITH RECURSIVE " + ", ".join(ctes) + " SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, host NOT IN "
            "(SELECT host FROM blocked)) THEN 'allow' ELSE 'block' END AS verdict FROM r")


def collocations_sql() -> str:
    """``op13_collocations``: every phrase of up to three words counted, then cuts, containment and ranks."""
    ctes = [
        "d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), "
        f"'{L.UPPER}', '{L.LOWER}') AS t FROM documents)",
        "p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)",
        "w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p)",
        "n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang)",
    ]
    for size in (1, 2, 3):
        cols = ", ".join(f"w[i + {k}] AS w{k}" for k in range(size))
        names = ", ".join(f"w{k}" for k in range(size))
        ctes.append(f"f{size} AS MATERIALIZED (SELECT lang, {names}, count(*) AS f FROM (SELECT lang, {cols} FROM (SELECT lang, w, "
                    f"unnest(range(1, len(w) + 2 - {size})) AS i FROM w)) GROUP BY lang, {names} HAVING count(*) >= {C.MIN_COUNT})")
    score = f"(CAST(a.f AS HUGEINT) * a.f * {C.SCALE}) // (CAST(x.f AS HUGEINT) * y.f)"
    two, three = "a.w0 || ' ' || a.w1", "a.w0 || ' ' || a.w1 || ' ' || a.w2"
    longer = lambda on: (f"NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = a.lang AND {on} "  # noqa: E731
                         f"AND 100 * z.f >= {C.CONTAINED_PERCENT} * a.f)")
    ctes += [
        f"c2 AS (SELECT a.lang, {two} AS phrase, a.f AS a, x.f AS l, y.f AS r, {score} AS score FROM f2 a "
        "JOIN f1 x ON x.lang = a.lang AND x.w0 = a.w0 JOIN f1 y ON y.lang = a.lang AND y.w0 = a.w1 "
        f"WHERE {longer('z.w0 = a.w0 AND z.w1 = a.w1')} AND {longer('z.w1 = a.w0 AND z.w2 = a.w1')})",
        f"k1 AS (SELECT a.lang, {three} AS phrase, a.f AS a, x.f AS l, y.f AS r, {score} AS score, 1 AS k FROM f3 a "
        "JOIN f1 x ON x.lang = a.lang AND x.w0 = a.w0 JOIN f2 y ON y.lang = a.lang AND y.w0 = a.w1 AND y.w1 = a.w2)",
        f"k2 AS (SELECT a.lang, {three} AS phrase, a.f AS a, x.f AS l, y.f AS r, {score} AS score, 2 AS k FROM f3 a "
        "JOIN f2 x ON x.lang = a.lang AND x.w0 = a.w0 AND x.w1 = a.w1 JOIN f1 y ON y.lang = a.lang AND y.w0 = a.w2)",
        "c3 AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o "
        "FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2)) WHERE o = 1)",
        "c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM "
        "(SELECT * FROM c2 UNION ALL SELECT * FROM c3))",
    ]
    return ("WITH " + ", ".join(ctes) + " SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score "
            f"FROM c JOIN n USING (lang) WHERE rank <= {C.TOP}")
