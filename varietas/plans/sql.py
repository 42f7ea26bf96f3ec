"""DuckDB SQL that mirrors the operators, put together from common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from .fixtures import SQL as FIXTURES

ROUND = 6


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def values(q: Sequence[float], of: str, norm: bool = True, what: str = "S", base: float | None = None, complete: bool = True, out: str = "vals") -> list[str]:
    """CTEs that end in ``out`` (gene, sample, q, value) over the fixture ``of``."""
    list_ = ", ".join(f"(CAST({x!r} AS DOUBLE))" for x in q)
    scale = "" if base is None else f" / ln({base!r})"
    if what == "D":
        formula = "CASE WHEN q = 1 THEN exp(s) ELSE pow(s, 1 / (1 - q)) END"
    elif norm:
        formula = "CASE WHEN n > 1 THEN CASE WHEN q = 1 THEN s / ln(n) ELSE ((1 - s) / (q - 1)) / ((1 - pow(n, 1 - q)) / (q - 1)) END END"
    else:
        formula = f"CASE WHEN q = 1 THEN s{scale} ELSE (1 - s) / (q - 1) END"
    last = f"SELECT * FROM cells_{out} WHERE gene IN (SELECT gene FROM cells_{out} GROUP BY gene HAVING count(value) = {len(q)} * (SELECT count(DISTINCT sample) FROM {of}))" if complete else f"SELECT * FROM cells_{out}"
    return [
        FIXTURES[of],
        f"tot_{out} AS (SELECT *, sum(cnt) OVER (PARTITION BY gene, sample) AS total FROM {of})",
        f"n_{out} AS (SELECT gene, CAST(count(DISTINCT tx) AS DOUBLE) AS n FROM {of} GROUP BY gene)",
        f"""sums_{out} AS (SELECT gene, sample, q, max(total) AS total,
    sum(CASE WHEN cnt > 0 AND total > 0 THEN CASE WHEN q = 1 THEN -(cnt / total) * ln(cnt / total) ELSE pow(cnt / total, q) END ELSE 0 END) AS s
  FROM tot_{out}, (VALUES {list_}) o(q) GROUP BY gene, sample, q)""",
        f"cells_{out} AS (SELECT gene, sample, q, CASE WHEN total > 0 THEN {formula} END AS value FROM sums_{out} JOIN n_{out} USING (gene))",
        f"{out} AS ({last})",
    ]


def grouped(of: str, source: str = "vals", out: str = "v") -> list[str]:
    """CTEs samples (sample, grp, ord) and ``out`` (gene, sample, q, value, grp), values rounded so that ties agree."""
    return [
        f"samples AS (SELECT sample, grp, row_number() OVER (ORDER BY sample) AS ord FROM (SELECT DISTINCT sample, grp FROM {of}))",
        f"{out} AS (SELECT gene, sample, q, round(value, 9) AS value, grp FROM {source} JOIN samples USING (sample))",
    ]


def fold_change(case: str, control: str, method: str = "avg", pseudocount: float = 0, source: str = "v", out: str = "fc", by: str = "") -> list[str]:
    """CTE ``out`` (by, gene, c, k, difference, log2_fold_change)."""
    keys = f"{by}, gene" if by else "gene"
    pseudo = f"{pseudocount!r}" if pseudocount > 0 else f"coalesce(least(min(CASE WHEN c > 0 THEN c END) {over(by)}, min(CASE WHEN k > 0 THEN k END) {over(by)}) / 2, 1e-6)"
    return [
        f"g_{out} AS (SELECT {keys}, {method}(CASE WHEN grp = '{case}' THEN value END) AS c, {method}(CASE WHEN grp = '{control}' THEN value END) AS k FROM {source} GROUP BY {keys})",
        f"p_{out} AS (SELECT *, {pseudo} AS pc FROM g_{out})",
        f"l_{out} AS (SELECT {keys}, CASE WHEN c <= 0 THEN pc ELSE c END AS c, CASE WHEN k <= 0 THEN pc ELSE k END AS k FROM p_{out})",
        f"{out} AS (SELECT *, c - k AS difference, CASE WHEN c / k > 0 THEN log2(c / k) END AS log2_fold_change FROM l_{out})",
    ]


def over(by: str) -> str:
    return f"OVER (PARTITION BY {by})" if by else "OVER ()"


def normal_p(z: str) -> str:
    """Two-sided tail of the normal distribution by its odd-factorial series, 1 where z is missing."""
    series = f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    return f"CASE WHEN {z} IS NULL OR {z} = 0 THEN 1.0 WHEN abs({z}) > 6 THEN 0.0 ELSE least(1.0, greatest(0.0, 1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series})) END"


def t_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom above 1, by the trigonometric series."""
    th = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({th}) * list_sum(list_transform(range(0, CAST({df} / 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({th}), 2 * j)))"
    odd = f"2 / pi() * ({th} + sin({th}) * list_sum(list_transform(range(0, CAST(({df} - 1) / 2 AS BIGINT)), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({th}), 2 * j + 1))))"
    return f"greatest(0.0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def t_p_any(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided tail of Student's t for any degrees of freedom: its density over the angle atan(t / sqrt(df)) by Simpson's rule."""
    th = f"atan(abs({t}) / sqrt({df}))"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inside = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(cos({th} * i / {steps}), {df} - 1))) * {th} / {3 * steps}"
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {inside})"


def first_component(source: str = "v", squarings: int = 14, out: str = "fc_scores") -> list[str]:
    """CTEs, a recursive one among them, that end in ``out`` (gene, sample, grp, score): complete curves on their first component.

    The cross products of the orders are squared again and again, which leaves the first eigenvector in every row.
    """
    scaled = "list_transform(m, lambda row: list_transform(row, lambda x: x / list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))))"
    return [
        f"fq AS (SELECT gene, sample, grp, q, value - avg(value) OVER (PARTITION BY gene, q) AS c FROM {source})",
        "fl AS (SELECT gene, sample, grp, list(c ORDER BY q) AS c FROM fq GROUP BY ALL)",
        "fg AS (SELECT gene, i, list(x ORDER BY j) AS row FROM (SELECT a.gene, a.q AS i, b.q AS j, sum(a.c * b.c) AS x FROM fq a JOIN fq b ON a.gene = b.gene AND a.sample = b.sample GROUP BY ALL) GROUP BY gene, i)",
        "f0 AS (SELECT gene, list(row ORDER BY i) AS m FROM fg GROUP BY gene)",
        f"""fr(gene, k, m) AS (SELECT gene, 0, {scaled} FROM f0 UNION ALL
    SELECT gene, k, {scaled} FROM (SELECT gene, k + 1 AS k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS m FROM fr WHERE k < {squarings}))""",
        f"fv AS (SELECT gene, list_transform(m, lambda row: row[1 + CAST(list_position(d, list_max(d)) - 1 AS INT)]) AS v FROM (SELECT gene, m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM fr WHERE k = {squarings}))",
        f"{out} AS (SELECT gene, sample, grp, list_dot_product(c, v) AS score FROM fl JOIN fv USING (gene))",
    ]


def welch(first: str, second: str, source: str = "fc_scores", out: str = "wt") -> list[str]:
    """CTE ``out`` (gene, t, df) of Welch's test."""
    return [
        f"ws AS (SELECT gene, avg(score) FILTER (grp = '{first}') - avg(score) FILTER (grp = '{second}') AS d, "
        + ", ".join(f"var_samp(score) FILTER (grp = '{g}') / count(*) FILTER (grp = '{g}') AS v{i}, count(*) FILTER (grp = '{g}') - 1 AS f{i}" for i, g in enumerate((first, second)))
        + f" FROM {source} GROUP BY gene)",
        f"{out} AS (SELECT gene, d / sqrt(v0 + v1) AS t, (v0 + v1) * (v0 + v1) / (v0 * v0 / f0 + v1 * v1 / f1) AS df FROM ws)",
    ]


def rank_sums(first: str, second: str, source: str = "v", out: str = "rs") -> list[str]:
    """CTE ``out`` (gene, n1, n2, u, tie_sum, z)."""
    return [
        f"""r_{out} AS (SELECT gene, grp, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rk,
    count(*) OVER (PARTITION BY gene, value) AS t FROM {source} WHERE value IS NOT NULL)""",
        f"""s_{out} AS (SELECT gene, count(*) FILTER (grp = '{first}') AS n1, count(*) FILTER (grp = '{second}') AS n2,
    coalesce(sum(rk) FILTER (grp = '{first}'), 0) AS r1, CAST(sum(t * t - 1) AS BIGINT) AS tie_sum FROM r_{out} GROUP BY gene)""",
        f"""w_{out} AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - tie_sum / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM s_{out})""",
        f"{out} AS (SELECT gene, n1, n2, u, tie_sum, CASE WHEN var > 0 THEN (u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / sqrt(var) END AS z FROM w_{out})",
    ]


def adjusted(method: str, source: str, p: str = "p", out: str = "adj") -> list[str]:
    """CTE ``out``: ``source`` with column a, the adjusted p."""
    ranked = f"o_{out} AS (SELECT *, count({p}) OVER () AS m, row_number() OVER (ORDER BY {p} NULLS LAST) AS i FROM {source})"
    down = f"OVER (ORDER BY {p} DESC NULLS LAST, i DESC ROWS UNBOUNDED PRECEDING)"
    up = f"OVER (ORDER BY {p} NULLS LAST, i ROWS UNBOUNDED PRECEDING)"
    step = {
        "BH": f"min(CASE WHEN {p} IS NOT NULL THEN m / i * {p} END) {down}",
        "BY": f"min(CASE WHEN {p} IS NOT NULL THEN list_sum(list_transform(range(1, m + 1), lambda k: 1 / k)) * m / i * {p} END) {down}",
        "hochberg": f"min(CASE WHEN {p} IS NOT NULL THEN (m - i + 1) * {p} END) {down}",
        "holm": f"max(CASE WHEN {p} IS NOT NULL THEN (m - i + 1) * {p} END) {up}",
        "bonferroni": f"m * {p}",
    }[method]
    return [ranked, f"{out} AS (SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1.0, {step}) END AS a FROM o_{out})"]


def hommel(source: str, p: str = "p", out: str = "adj") -> list[str]:
    """CTE ``out``: ``source`` with column a, by closed testing with Simes tests: e is the level at which a set of m is rejected."""
    return [
        f"hs AS (SELECT {p} AS p, row_number() OVER (ORDER BY {p}) AS i, count(*) OVER () AS n FROM {source} WHERE {p} IS NOT NULL)",
        "hc AS (SELECT m, min(m * p / (i - (n - m))) AS c FROM hs JOIN (SELECT i AS m FROM hs) ON i > n - m GROUP BY m)",
        "he AS (SELECT m, max(c) OVER (ORDER BY m DESC ROWS UNBOUNDED PRECEDING) AS e FROM hc)",
        f"hm AS (SELECT p, coalesce(max(m), 0) AS most FROM (SELECT DISTINCT {p} AS p FROM {source} WHERE {p} IS NOT NULL) LEFT JOIN he ON e > m * p GROUP BY p)",
        f"{out} AS (SELECT s.*, CASE WHEN s.{p} IS NOT NULL THEN least(1.0, greatest(coalesce(e, 0), most * s.{p})) END AS a FROM {source} s LEFT JOIN hm ON hm.p = s.{p} LEFT JOIN he ON m = most + 1)",
    ]


def mixed_ratio(thetas: Sequence[float], source: str = "v", out: str = "lr") -> list[str]:
    """CTE ``out`` (gene, z): the root of the likelihood ratio of a slope for each of two groups against one for both, samples being subjects of one group.

    With a random intercept, cross products about the groups' means are weighted by theta; theta is the best of ``thetas``.
    """
    sxx, sxy, syy = "(qq - q1 * q1 / s1)", "(qy - q1 * y1 / s1)", "(yy - y1 * y1 / s1)"
    level = lambda rss: f"max(-0.5 * (n * ln(2 * pi() * {rss} / n) + n + logdet))"
    return [
        f"mc AS (SELECT gene, grp, sample, count(*) AS n, sum(q) AS q, sum(q * q) AS qq, sum(value) AS y, sum(value * value) AS yy, sum(q * value) AS qy FROM {source} GROUP BY ALL)",
        f"mw AS (SELECT *, theta * theta / (1 + n * theta * theta) AS w FROM mc, (SELECT unnest({[float(t) for t in thetas]}::DOUBLE[]) AS theta))",
        "mg AS (SELECT gene, theta, grp, sum(n) AS n, sum(n - w * n * n) AS s1, sum(q - w * n * q) AS q1, sum(qq - w * q * q) AS qq, sum(y - w * n * y) AS y1, sum(yy - w * y * y) AS yy, sum(qy - w * q * y) AS qy, sum(ln(1 + n * theta * theta)) AS logdet FROM mw GROUP BY ALL)",
        f"mf AS (SELECT gene, theta, sum(n) AS n, sum(logdet) AS logdet, sum({syy} - {sxy} * {sxy} / {sxx}) AS rss1, sum({syy}) - sum({sxy}) * sum({sxy}) / sum({sxx}) AS rss0 FROM mg GROUP BY ALL)",
        f"{out} AS (SELECT gene, sqrt(greatest(0, 2 * ({level('rss1')} - {level('rss0')}))) AS z FROM mf GROUP BY gene)",
    ]


def exact_p(kind: str, source: str, out: str = "ex") -> list[str]:
    """CTEs, recursive ones among them, that end in ``out`` (gene, p): twice the smaller tail of all placings of ranks.

    ``source`` has gene, n (ranks), k (how many of them are summed, or, signed, any number), s (their sum), fair.
    """
    signed = kind == "signed"
    match = "w.r = x.n" if signed else "w.r = x.n AND w.k = x.k"
    return [
        f"""ways(r, k, s, c) AS (SELECT 0, 0, 0, CAST(1 AS DOUBLE) UNION ALL
    SELECT w.r + 1, {0 if signed else 'w.k + take'}, w.s + take * (w.r + 1), sum(w.c) FROM ways w, (VALUES (0), (1)) t(take)
    WHERE w.r < (SELECT max(n) FROM {source}) GROUP BY ALL)""",
        f"tails AS (SELECT gene, sum(c) AS every, sum(c) FILTER (w.s <= x.s) AS low, sum(c) FILTER (w.s >= x.s) AS high FROM {source} x JOIN ways w ON {match} WHERE fair GROUP BY gene)",
        f"{out} AS (SELECT x.gene, coalesce(least(1.0, 2 * least(low, high) / every), 1.0) AS p FROM {source} x LEFT JOIN tails USING (gene))",
    ]


def r(x: str, name: str | None = None) -> str:
    """``x`` rounded and without a negative zero, under its name."""
    return f"round({x}, {ROUND}) + 0.0 AS {name or x}"
