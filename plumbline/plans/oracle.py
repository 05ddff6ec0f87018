"""SQL for an independent engine: the expected result of each registered query.

Written from the definitions, not from the Spark plans: long windows, self joins
and cross products are fine here, since it only checks results.
"""

from __future__ import annotations

import re

from plumbline.operators.experiments import RATES
from plumbline.operators.reliability import ALPHA, simplex_grid
from plumbline.plans.bindings import (
    DOCUMENT_VIEWS,
    EVENT_CLASSES,
    EVENT_VIEWS,
    LINE_VIEWS,
)
from plumbline.plans.catalog import (
    CLAIMS,
    CV_FOLDS,
    CV_REPEATS,
    EVENT_CLASS_MAP,
    LINE_CLASS_MAP,
    PERMUTATIONS,
)
from plumbline.operators.consolidate import EXPERIMENTS
from plumbline.spec import ViewSpec

SEED = 42


def R(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def bucket(*keys: str, seed: object = SEED, buckets: int = 100) -> str:
    parts = " || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT % {buckets})"


def split_sql(key: str) -> str:
    b = bucket(key)
    return f"CASE WHEN {b} < 60 THEN 'train' WHEN {b} < 80 THEN 'validation' ELSE 'test' END"


def fin(x: str) -> str:
    return f"CASE WHEN isfinite(({x})::DOUBLE) THEN ({x})::DOUBLE END"


def q_cols(spec: ViewSpec) -> str:
    out = []
    for v, fs in spec.views.items():
        valid = " + ".join(f"({f} IS NOT NULL AND isfinite({f}))::INT" for f in fs)
        out.append(f"({valid}) / {float(len(fs))}::DOUBLE AS q_{v}")
    return ", ".join(out)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV = f"""
ev0 AS (
  SELECT event_id AS record_id, user_id AS entity, epoch_us(ts) AS ts_us, event_type AS class,
         (event_type = 'error')::INT AS y, {split_sql('event_id')} AS split, value,
         regexp_extract(props, '"k": *(-?[0-9]+)', 1)::DOUBLE AS k,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap
  FROM events),
ev AS (
  SELECT *, 1.0::DOUBLE AS i,
         CASE WHEN ts_us IS NULL THEN 0.0::DOUBLE WHEN gap IS NULL THEN 0.5::DOUBLE
              ELSE 1.0::DOUBLE / (1.0::DOUBLE + gap / 86400.0::DOUBLE) END AS t,
         {q_cols(EVENT_VIEWS)}
  FROM ev0)"""

LINE_KEY = (
    "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "floor(l_extendedprice * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT)"
)
LI = f"""
li00 AS (
  SELECT {LINE_KEY} AS record_id, l_linestatus AS dataset, l_orderkey AS entity,
         epoch_us(l_shipdate) AS ts_us, l_returnflag AS class, (l_returnflag = 'R')::INT AS y,
         CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'mismatch' ELSE 'unlisted' END AS status,
         (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS lag_seconds,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
li0 AS (SELECT *, lag_seconds / 86400.0::DOUBLE AS lag_days, {split_sql('record_id')} AS split FROM li00),
li AS (
  SELECT *, CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'mismatch' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS i,
         CASE WHEN ts_us IS NULL OR NOT coalesce(lag_seconds >= 0, false) THEN 0.0::DOUBLE
              ELSE 1.0::DOUBLE / (1.0::DOUBLE + lag_seconds / 86400.0::DOUBLE) END AS t,
         {q_cols(LINE_VIEWS)}
  FROM li0)"""

DOC = """
doc AS (
  SELECT d.doc_id AS record_id, source || '/' || lang AS file, lang AS dataset, text,
         n_chars::DOUBLE AS n_chars,
         (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS n_words,
         (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS n_lines,
         l.quality AS y, l.toxic::DOUBLE AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def params(spec: ViewSpec, src: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    cols = []
    for c in (0, 1):
        cols.append(f"count(*) FILTER (WHERE y = {c}) AS n{c}")
        for f in spec.features:
            cols += [
                f"count({f}) FILTER (WHERE y = {c}) AS {f}__n{c}",
                f"avg({f}) FILTER (WHERE y = {c}) AS {f}__m{c}",
                f"greatest(var_samp({f}) FILTER (WHERE y = {c}), 1e-9) AS {f}__v{c}",
            ]
    return f"SELECT {head}{', '.join(cols)} FROM {src}" + (f" GROUP BY {by}" if by else "")


def p_cols(spec: ViewSpec, P: str = "P", row: str = "b") -> str:
    out = []
    for v, fs in spec.views.items():
        terms = [
            f"coalesce(0.5::DOUBLE * ln({P}.{f}__v0 / {P}.{f}__v1)"
            f" - ({row}.{f} - {P}.{f}__m1) * ({row}.{f} - {P}.{f}__m1) / (2 * {P}.{f}__v1)"
            f" + ({row}.{f} - {P}.{f}__m0) * ({row}.{f} - {P}.{f}__m0) / (2 * {P}.{f}__v0), 0.0::DOUBLE)"
            for f in fs
        ]
        z = f"ln({P}.n1::DOUBLE / nullif({P}.n0, 0)::DOUBLE) + " + " + ".join(terms)
        seen = ", ".join(f"{row}.{f}" for f in fs)
        out.append(
            f"CASE WHEN coalesce({seen}) IS NOT NULL THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) END AS p_{v}"
        )
    return ", ".join(out)


def weights(spec: ViewSpec, src: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    cols = [
        f"greatest(abs(avg(p_{v}) FILTER (WHERE y = 1) - avg(p_{v}) FILTER (WHERE y = 0)), 1e-6) AS g_{v}"
        for v in spec.names
    ]
    return f"SELECT {head}{', '.join(cols)} FROM {src}" + (f" GROUP BY {by}" if by else "")


def wsum(spec: ViewSpec, w: dict[str, str]) -> str:
    return " + ".join(f"CASE WHEN p_{v} IS NOT NULL THEN {w[v]} ELSE 0.0::DOUBLE END" for v in spec.names)


def wmass(spec: ViewSpec, w: dict[str, str]) -> str:
    return " + ".join(f"coalesce(({w[v]}) * p_{v}, 0.0::DOUBLE)" for v in spec.names)


def fused(spec: ViewSpec, w: dict[str, str]) -> str:
    return f"(({wmass(spec, w)}) / nullif({wsum(spec, w)}, 0))"


def plain(spec: ViewSpec) -> str:
    return fused(spec, {v: "1.0::DOUBLE" for v in spec.names})


def gr(spec: ViewSpec, alpha=None, g: bool = True) -> dict[str, str]:
    a_i, a_q, a_t = alpha or [f"{a}::DOUBLE" for a in ALPHA]
    return {
        v: (f"g_{v} * " if g else "") + f"({a_i} * i + {a_q} * q_{v} + {a_t} * t)" for v in spec.names
    }


def theta(src: str, by: str = "", score: str = "s") -> str:
    """The distinct score with the best Youden index; the lowest of several."""
    head = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    SELECT {head}theta, value AS youden FROM (
      SELECT {head}theta, value, row_number() OVER ({part} ORDER BY value DESC, theta) AS pick
      FROM (SELECT {head}theta, coalesce(round(
                sum(pos) OVER ({part} ORDER BY theta DESC)::DOUBLE / nullif(sum(pos) OVER ({part}), 0)
              - sum(neg) OVER ({part} ORDER BY theta DESC)::DOUBLE / nullif(sum(neg) OVER ({part}), 0), 9), -1.0::DOUBLE) AS value
            FROM (SELECT {head}coalesce({score}, -1.0::DOUBLE) AS theta,
                         count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
                  FROM {src} WHERE y IS NOT NULL GROUP BY ALL))
      WHERE theta >= 0)
    WHERE pick = 1"""


RATE_COLS = """
  (tp + tn) / nullif(tp + fp + tn + fn, 0) AS accuracy, tp / nullif(tp + fp, 0) AS "precision",
  tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
  2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
  (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy,
  (tp::DOUBLE * tn - fp::DOUBLE * fn)
    / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0) AS mcc"""
RATE_NAMES = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc"]


def metrics(src: str, by: str) -> str:
    """Counts, AUC by exact pair counts, Brier score and rates; ``theta`` is a column of ``src``."""
    return f"""
    SELECT *, {RATE_COLS} FROM (
      SELECT {by}, sum(pos + neg)::BIGINT AS n, sum(miss)::BIGINT AS n_unscored, sum(hp)::BIGINT AS tp, sum(hn)::BIGINT AS fp,
             sum(neg - hn)::BIGINT AS tn, sum(pos - hp)::BIGINT AS fn,
             sum(pos * (below + neg / 2)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auc,
             sum(sse) / nullif(sum(pos + neg - miss), 0) AS brier
      FROM (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY v) - neg AS below
            FROM (SELECT {by}, coalesce(s, -1.0::DOUBLE) AS v,
                         count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg,
                         count(*) FILTER (WHERE y = 1 AND s >= theta) AS hp,
                         count(*) FILTER (WHERE y = 0 AND s >= theta) AS hn,
                         count(*) FILTER (WHERE s IS NULL) AS miss, sum((s - y) * (s - y)) AS sse
                  FROM {src} WHERE y IS NOT NULL GROUP BY ALL))
      GROUP BY ALL)"""


def metric_list(keys: str) -> str:
    cols = ", ".join(f'{R(chr(34) + m + chr(34))} AS "{m}"' for m in ["auc", "brier", *RATE_NAMES])
    return f"{keys}, n, n_unscored, tp, fp, tn, fn, {cols}"


def variants(spec: ViewSpec, src: str, keep: str, w: dict[str, str]) -> str:
    parts = [(f"view:{v}", f"p_{v}") for v in spec.names]
    parts += [("unweighted", plain(spec)), ("reliability", fused(spec, w))]
    return " UNION ALL ".join(f"SELECT {keep}, '{n}' AS variant, {s} AS s FROM {src}" for n, s in parts)


def chain(spec: ViewSpec, base: str) -> list[str]:
    """Fit on train, score all, weigh on validation, join the weights."""
    return [
        f"train AS (SELECT * FROM {base} WHERE split = 'train')",
        f"par AS ({params(spec, 'train')})",
        f"scored AS (SELECT b.*, {p_cols(spec)} FROM {base} b, par P)",
        "val AS (SELECT * FROM scored WHERE split = 'validation')",
        f"wts AS ({weights(spec, 'val')})",
        "sw AS (SELECT * FROM scored, wts)",
    ]


def values(rows: list[tuple], names: list[str]) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def grid_values(names: list[str]) -> str:
    rows = [(j, *[float(p[n]) for n in names]) for j, p in enumerate(simplex_grid(tuple(names)))]
    return values(rows, ["grid_id", *names])


EVC = [EV, *chain(EVENT_VIEWS, "ev")]
LIC = [LI, *chain(LINE_VIEWS, "li")]
FIT = ("a_i", "a_q", "a_t")


def alpha_fit(spec: ViewSpec, src: str, by: str = "") -> list[str]:
    """Coefficients with the lowest Brier score over ``src``, one row per group."""
    head = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return [
        f"agrid AS (SELECT * FROM {grid_values(list(FIT))})",
        f"""alpha AS (SELECT {head}grid_id, a_i, a_q, a_t, loss FROM (
          SELECT *, row_number() OVER ({part} ORDER BY round(loss, 9), grid_id) AS pick
          FROM (SELECT {head}grid_id, a_i, a_q, a_t, avg((s - y) * (s - y)) AS loss
                FROM (SELECT {head}agrid.*, y, {fused(spec, gr(spec, FIT))} AS s FROM {src}, agrid) GROUP BY ALL))
          WHERE pick = 1)""",
    ]


LIA = [
    *LIC,
    "svl0 AS (SELECT * FROM sw WHERE split = 'validation')",
    *alpha_fit(LINE_VIEWS, "svl0"),
    "aw AS (SELECT sw.*, a_i, a_q, a_t FROM sw, alpha)",
]
LIF = [*LIA, f"fz AS (SELECT *, {fused(LINE_VIEWS, gr(LINE_VIEWS, FIT))} AS s FROM aw)"]
LIT = [
    *LIF,
    "fv AS (SELECT * FROM fz WHERE split = 'validation')",
    f"th AS ({theta('fv')})",
    "ft AS (SELECT fz.*, th.theta FROM fz, th WHERE split = 'test')",
]


def newton(spec: ViewSpec, src: str, par: str, by: str = "", steps: int = 6, ridge: float = 1e-3) -> list[str]:
    """Logistic regression: ``ls`` (mean and spread of the features) and ``lb`` (coefficients), one row per group."""
    fs, d = spec.features, len(spec.features) + 1
    head, join = (f"{by}, ", lambda t: f"JOIN {t} USING ({by})") if by else ("", lambda t: f"CROSS JOIN {t}")
    mu, sd = [], []
    for f in fs:
        m = (
            f"coalesce((coalesce({f}__n0 * {f}__m0, 0.0::DOUBLE) + coalesce({f}__n1 * {f}__m1, 0.0::DOUBLE)) "
            f"/ nullif({f}__n0 + {f}__n1, 0), 0.0::DOUBLE)"
        )
        inside = " + ".join(f"CASE WHEN {f}__n{c} > 1 THEN ({f}__n{c} - 1) * {f}__v{c} ELSE 0.0::DOUBLE END" for c in (0, 1))
        apart = " + ".join(f"coalesce({f}__n{c} * ({f}__m{c} - {m}) * ({f}__m{c} - {m}), 0.0::DOUBLE)" for c in (0, 1))
        v = f"(({inside}) + ({apart})) / nullif({f}__n0 + {f}__n1 - 1, 0)"
        mu.append(f"{m} AS {f}__mu")
        sd.append(f"CASE WHEN {v} > 1e-12 THEN sqrt({v}) ELSE 1.0::DOUBLE END AS {f}__sd")
    z = ["1.0::DOUBLE AS z0", *[f"coalesce(({f} - {f}__mu) / {f}__sd, 0.0::DOUBLE) AS z{j + 1}" for j, f in enumerate(fs)]]
    bs = [f"b{i}" for i in range(d)]
    ctes = [
        f"ls AS (SELECT {head}{', '.join(mu + sd)} FROM {par})",
        f"lz AS (SELECT {head}y::DOUBLE AS y, {', '.join(z)} FROM {src} {join('ls')} WHERE y IS NOT NULL)",
        f"lb0 AS (SELECT {head}{', '.join(f'0.0::DOUBLE AS {b}' for b in bs)} FROM ls)",
    ]
    dot = " + ".join(f"b{i} * z{i}" for i in range(d))
    for k in range(steps):
        sums = [f"sum(p * (1 - p) * z{i} * z{j}) AS a{i}_{j}" for i in range(d) for j in range(i, d)]
        sums += [f"sum((y - p) * z{i}) AS r{i}" for i in range(d)]
        ctes.append(
            f"lg{k} AS (SELECT {head}count(*) AS n, min(y) < max(y) AS both_, {', '.join(f'any_value({b}) AS {b}' for b in bs)}, "
            f"{', '.join(sums)} FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({dot}))) AS p FROM lz {join(f'lb{k}')}) GROUP BY ALL)"
        )
        pen = [f"{ridge}::DOUBLE * n" if i else "0.0::DOUBLE" for i in range(d)]
        keep = f"{head}both_, {', '.join(bs)}"
        full = [
            f"a{min(i, j)}_{max(i, j)}" + (f" + {pen[i]}" if i == j else "") + f" AS m{i}_{j}" for i in range(d) for j in range(d)
        ]
        sql = f"SELECT {keep}, {', '.join(full)}, {', '.join(f'r{i} - {pen[i]} * b{i} AS c{i}' for i in range(d))} FROM lg{k}"
        for p in range(d - 1):  # elimination, a column at a time
            cells = [
                (f"m{i}_{j}" if i <= p else f"m{i}_{j} - m{i}_{p} / m{p}_{p} * m{p}_{j} AS m{i}_{j}") for i in range(d) for j in range(d)
            ]
            right = [f"c{i}" if i <= p else f"c{i} - m{i}_{p} / m{p}_{p} * c{p} AS c{i}" for i in range(d)]
            sql = f"SELECT {keep}, {', '.join(cells + right)} FROM ({sql})"
        for i in reversed(range(d)):
            known = "".join(f" - m{i}_{j} * x{j}" for j in range(i + 1, d))
            sql = f"SELECT *, (c{i}{known}) / m{i}_{i} AS x{i} FROM ({sql})"
        moved = ", ".join(f"CASE WHEN both_ THEN b{i} + x{i} ELSE b{i} END AS b{i}" for i in range(d))
        ctes.append(f"{'lb' if k == steps - 1 else f'lb{k + 1}'} AS (SELECT {head}{moved} FROM ({sql}))")
    return ctes


def p_logistic(spec: ViewSpec, row: str = "b") -> str:
    """Needs the columns of ``ls`` and ``lb``."""
    z = " + ".join(f"b{j + 1} * coalesce(({row}.{f} - {f}__mu) / {f}__sd, 0.0::DOUBLE)" for j, f in enumerate(spec.features))
    seen = ", ".join(f"{row}.{f}" for f in spec.features)
    return f"CASE WHEN coalesce({seen}) IS NOT NULL THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(b0 + {z}))) END AS p_logit"


ORACLE: dict[str, str] = {}

# ---- fusion -----------------------------------------------------------------

ORACLE["reliability_fusion"] = with_(
    *EVC, "svl0 AS (SELECT * FROM sw WHERE split = 'validation')", *alpha_fit(EVENT_VIEWS, "svl0")
) + (
    f"SELECT record_id, split, y, {R(fused(EVENT_VIEWS, gr(EVENT_VIEWS, FIT)))} AS s, "
    f"{R(plain(EVENT_VIEWS))} AS s_unweighted FROM sw, alpha"
)
ORACLE["unweighted_fusion"] = with_(*EVC) + f"SELECT record_id, {R(plain(EVENT_VIEWS))} AS s_unweighted FROM scored"
ORACLE["view_weights"] = with_(*EVC) + " UNION ALL ".join(
    f"SELECT '{v}' AS view, {R(f'g_{v}')} AS g FROM wts" for v in EVENT_VIEWS.names
)
_long_views = " UNION ALL ".join(
    f"SELECT record_id, split, y, '{v}' AS view, p_{v} AS s FROM scored" for v in EVENT_VIEWS.names
)
ORACLE["view_predictions"] = with_(
    *EVC, f"pl AS ({_long_views})", "pv AS (SELECT * FROM pl WHERE split = 'validation')", f"pt AS ({theta('pv', 'view')})"
) + (
    f"SELECT record_id, pl.view AS view, {R('s')} AS score, (s >= theta)::INT::DOUBLE AS pred "
    "FROM pl LEFT JOIN pt ON pl.view = pt.view"
)
ORACLE["view_parameters"] = with_(*LIC) + " UNION ALL ".join(
    f"SELECT '{v}' AS view, '{f}' AS feature, {c} AS class, {R(f'{f}__m{c}', 4)} AS mean, "
    f"{R(f'sqrt({f}__v{c})', 4)} AS sd, {f}__n{c} AS n FROM par"
    for v, f in LINE_VIEWS.pairs
    for c in (0, 1)
)

MANIFEST = """
man AS (
  SELECT file, sum(n_chars)::BIGINT AS length,
         sha256(file || '|' || count(*) || '|' || sum(('0x' || substr(sha256(record_id || '|' || coalesce(text, '')), 1, 15))::BIGINT)) AS sha256,
         CASE WHEN count(toxic) = 0 THEN 'unlisted' WHEN max(toxic) = 1 THEN 'mismatch' ELSE 'verified' END AS status
  FROM doc GROUP BY file)"""
ORACLE["integrity_factor"] = with_(DOC, MANIFEST) + (
    "SELECT record_id, status, CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'mismatch' THEN 0.0::DOUBLE "
    "ELSE 0.5::DOUBLE END AS i FROM doc LEFT JOIN man USING (file)"
)
ORACLE["attached_integrity"] = with_(DOC, MANIFEST) + (
    "SELECT record_id, file, length, sha256, status FROM doc LEFT JOIN man USING (file)"
)
ORACLE["verified_integrity"] = with_(
    DOC,
    "a AS (SELECT record_id AS file, sha256(CASE WHEN toxic = 1 THEN text || '~' ELSE text END) AS recorded FROM doc WHERE y IS NOT NULL)",
    "b AS (SELECT record_id AS file, sha256(text) AS recomputed FROM doc WHERE coalesce(y, 1) = 1)",
) + (
    "SELECT coalesce(a.file, b.file) AS file, recorded, recomputed, CASE WHEN recomputed IS NULL THEN 'missing' "
    "WHEN recorded IS NULL THEN 'unlisted' WHEN recorded = recomputed THEN 'verified' ELSE 'mismatch' END AS status "
    "FROM a FULL JOIN b ON a.file = b.file"
)
_file = lambda segment: (
    f"sha256('c_custkey,c_nationkey,c_mktsegment' || chr(10) || string_agg(c_custkey || ',' || c_nationkey || ',' || {segment} || chr(10), '' ORDER BY c_custkey))"
)
ORACLE["file_integrity_chain"] = with_(
    """cu AS (SELECT *, c_custkey // 100 AS file, CASE WHEN c_custkey // 100 % 5 = 1 AND c_custkey % 100 = 50 THEN 'ALTERED' ELSE c_mktsegment END AS segment
       FROM customer)""",
    f"fi AS (SELECT file, CASE WHEN file % 7 <> 3 THEN {_file('c_mktsegment')} END AS recorded, {_file('segment')} AS recomputed FROM cu GROUP BY file)",
    "fs AS (SELECT *, CASE WHEN recorded IS NULL THEN 'unlisted' WHEN recorded = recomputed THEN 'verified' ELSE 'mismatch' END AS status FROM fi)",
) + """SELECT c_custkey AS record_id, file, segment AS c_mktsegment, recorded, recomputed, status,
       CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'mismatch' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS i FROM cu JOIN fs USING (file)"""
ORACLE["quality_factor"] = with_(DOC, f"dq AS (SELECT *, {q_cols(DOCUMENT_VIEWS)} FROM doc)") + " UNION ALL ".join(
    f"SELECT record_id, '{v}' AS view, {R(f'q_{v}')} AS q FROM dq" for v in DOCUMENT_VIEWS.names
)
ORACLE["temporal_factor"] = with_(EV) + f"SELECT record_id, entity, {R('gap')} AS gap, {R('t')} AS t FROM ev"
ORACLE["temporal_order_rule"] = with_(LI) + f"SELECT record_id, {R('lag_days', 12)} AS lag_days, {R('t', 12)} AS t FROM li"
_rel = gr(LINE_VIEWS, g=False)
ORACLE["reliability_vector"] = with_(LI) + " UNION ALL ".join(
    f"SELECT record_id, {R('i', 12)} AS i, {R('t', 12)} AS t, '{v}' AS view, {R(f'q_{v}', 12)} AS q, {R(_rel[v], 12)} AS r FROM li"
    for v in LINE_VIEWS.names
)

_ga = gr(LINE_VIEWS, FIT)
ORACLE["reliability_coefficients"] = with_(*LIA) + (
    f"SELECT grid_id, {R('a_i')} AS a_i, {R('a_q')} AS a_q, {R('a_t')} AS a_t, {R('loss')} AS loss FROM alpha"
)
VT = [
    *LIA,
    "svl AS (SELECT * FROM aw WHERE split = 'validation')",
    f"vl AS ({variants(LINE_VIEWS, 'svl', 'y', gr(LINE_VIEWS, FIT))})",
    f"vt AS ({theta('vl', 'variant')})",
]
ORACLE["decision_threshold"] = with_(*VT) + f"SELECT variant, {R('theta')} AS theta, {R('youden')} AS youden FROM vt"

_names = LINE_VIEWS.names
_for = " + ".join(f"CASE WHEN p_{v} IS NOT NULL AND p_{v} >= theta THEN w_{v} ELSE 0.0::DOUBLE END" for v in _names)
_against = " + ".join(f"CASE WHEN p_{v} IS NOT NULL AND p_{v} < theta THEN w_{v} ELSE 0.0::DOUBLE END" for v in _names)
_w = {v: f"w_{v}" for v in _names}
_up = ", ".join(f"CASE WHEN p_{v} >= theta THEN '{v}' END" for v in _names)
_down = ", ".join(f"CASE WHEN p_{v} < theta THEN '{v}' END" for v in _names)
_share_top = " ".join(
    f"WHEN share_{v} >= greatest({', '.join(f'share_{u}' for u in _names)}) THEN '{v}'" for v in sorted(_names, reverse=True)
)
CASES = [
    *LIA,
    "wz AS (SELECT *, " + ", ".join(f"{_ga[v]} AS w_{v}" for v in _names) + " FROM aw)",
    f"fz AS (SELECT *, {fused(LINE_VIEWS, _w)} AS s FROM wz)",
    "fv AS (SELECT * FROM fz WHERE split = 'validation')",
    f"th AS ({theta('fv')})",
    f"""pre AS (
      SELECT fz.*, theta, {wsum(LINE_VIEWS, _w)} AS w_all, {_for} AS w_for, {_against} AS w_against,
             {wmass(LINE_VIEWS, _w)} AS w_mass FROM fz, th)""",
    "shr AS (SELECT *, "
    + ", ".join(f"w_{v} * p_{v} / nullif(w_mass, 0) AS share_{v}" for v in _names)
    + " FROM pre)",
    f"""cas AS (
      SELECT *, CASE WHEN s IS NULL OR i = 0 THEN 'insufficient'
                     WHEN w_for >= 0.3::DOUBLE * w_all AND w_against >= 0.3::DOUBLE * w_all THEN 'contested'
                     WHEN s >= theta THEN 'attack' ELSE 'benign' END AS verdict,
             concat_ws(',', {_up}) AS supporting, concat_ws(',', {_down}) AS contradicting,
             CASE {_share_top} END AS top_view FROM shr)""",
]
ORACLE["forensic_reasoning"] = with_(*CASES) + (
    f"SELECT record_id, {R('s')} AS s, verdict, supporting, contradicting, top_view, "
    + ", ".join(f"{R(f'share_{v}', 4)} AS share_{v}" for v in _names)
    + " FROM cas"
)
_spread = " + ".join(f"coalesce(w_{v} * (p_{v} - s) * (p_{v} - s), 0.0::DOUBLE)" for v in _names)
_gsum = wsum(LINE_VIEWS, {v: f"g_{v}" for v in _names})
CONF = [
    *CASES,
    f"""cp AS (SELECT *, w_all / nullif({_gsum}, 0) AS c_r,
         1.0::DOUBLE - 2.0::DOUBLE * sqrt(({_spread}) / nullif(w_all, 0)) AS c_a,
         abs(s - theta) / greatest(theta, 1.0::DOUBLE - theta) AS c_m,
         ((verdict = 'attack' AND y = 1) OR (verdict = 'benign' AND y = 0))::INT::DOUBLE AS ok FROM cas)""",
    f"bgrid AS (SELECT * FROM {grid_values(['b_r', 'b_a', 'b_m'])})",
    """beta AS (
      SELECT grid_id, b_r, b_a, b_m, avg((b_r * c_r + b_a * c_a + b_m * c_m - ok) * (b_r * c_r + b_a * c_a + b_m * c_m - ok)) AS loss
      FROM cp, bgrid WHERE split = 'validation' GROUP BY ALL ORDER BY round(loss, 9), grid_id LIMIT 1)""",
    "cf AS (SELECT cp.*, b_r * c_r + b_a * c_a + b_m * c_m AS confidence FROM cp, beta)",
]
ORACLE["investigation_confidence"] = with_(*CONF) + (
    f"SELECT record_id, verdict, {R('c_r')} AS c_r, {R('c_a')} AS c_a, {R('c_m')} AS c_m, {R('confidence')} AS confidence FROM cf"
)


def _cell(x: str, cells: int) -> str:
    return f"floor(least(greatest(round({x}, 9), 0.0::DOUBLE), 1.0::DOUBLE) * {cells})::INT"


# The isotonic fit at a cell: the largest, over starts at or below it, of the least mean up to an end at or above it.
CALIBRATED = [
    *CONF,
    f"""ih AS (SELECT {_cell('confidence', 4096)} AS cell, count(*) AS n, sum(ok)::BIGINT AS hits FROM cf
           WHERE split = 'validation' AND confidence IS NOT NULL GROUP BY ALL)""",
    "ic AS (SELECT cell, sum(n) OVER (ORDER BY cell) AS n, sum(hits) OVER (ORDER BY cell) AS hits, n AS own, hits AS own_hits FROM ih)",
    """im AS (SELECT a.cell AS i, b.cell AS j, min((b.hits - a.hits + a.own_hits)::DOUBLE / (b.n - a.n + a.own)::DOUBLE)
             OVER (PARTITION BY a.cell ORDER BY b.cell DESC) AS low FROM ic a JOIN ic b ON b.cell >= a.cell)""",
    "iv AS (SELECT j AS cell, max(low) AS value FROM im GROUP BY j)",
    f"""ca AS (SELECT cf.*, CASE WHEN confidence IS NOT NULL THEN coalesce(iv.value, (SELECT min(value) FROM iv)) END AS calibrated
           FROM (SELECT *, {_cell('confidence', 4096)} AS cell FROM cf) cf ASOF LEFT JOIN iv ON cf.cell >= iv.cell)""",
]
ORACLE["calibrated_confidence"] = with_(*CALIBRATED) + (
    f"SELECT record_id, split, {R('confidence')} AS confidence, {R('calibrated')} AS calibrated FROM ca"
)
ORACLE["calibration_error"] = with_(
    *CALIBRATED,
    "cl AS (SELECT split, ok, 'confidence' AS measure, confidence AS c FROM ca UNION ALL SELECT split, ok, 'calibrated', calibrated FROM ca)",
    f"""cb AS (SELECT split, measure, least({_cell('c', 10)}, 9) AS bin, count(*) AS n, abs(avg(c) - avg(ok)) AS gap,
           sum((c - ok) * (c - ok)) AS sse FROM cl WHERE c IS NOT NULL GROUP BY ALL)""",
) + f"""SELECT split, measure, sum(n)::BIGINT AS n, count(*) AS bins, {R('sum(n * gap) / sum(n)')} AS expected_error,
       {R('max(gap)')} AS largest_error, {R('sum(sse) / sum(n)')} AS brier FROM cb GROUP BY split, measure"""

# ---- preparation ------------------------------------------------------------

ORACLE["clean_records"] = """
SELECT doc_id, lang, source, n_chars::DOUBLE AS n_chars, md5(text) AS digest FROM documents
WHERE text IS NOT NULL AND n_chars IS NOT NULL
  AND doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text, lang, source, n_chars)"""

_case = lambda col, m: f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in m.items()) + " END"
_y = lambda c: f"({c} <> 'benign')::INT"
ORACLE["harmonized_records"] = f"""
SELECT record_id, dataset, entity, ts_us, class, {_y('class')}::DOUBLE AS y, amount, k, discount FROM (
  SELECT event_id::VARCHAR AS record_id, 'events' AS dataset, user_id::VARCHAR AS entity, epoch_us(ts) AS ts_us,
         {_case('event_type', EVENT_CLASS_MAP)} AS class, value AS amount,
         regexp_extract(props, '"k": *(-?[0-9]+)', 1)::DOUBLE AS k, NULL::DOUBLE AS discount FROM events
  UNION ALL
  SELECT {LINE_KEY}, 'lines', l_orderkey::VARCHAR, epoch_us(l_shipdate), {_case('l_returnflag', LINE_CLASS_MAP)},
         l_extendedprice, NULL::DOUBLE, l_discount FROM lineitem)"""
ORACLE["transformed_features"] = with_(
    LI,
    """fit AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, avg(l_discount) AS dm, stddev_samp(l_discount) AS ds,
              min(l_tax) AS t0, max(l_tax) AS t1 FROM li WHERE split = 'train')""",
) + f"""
SELECT record_id, split, {R('(l_quantity - q0) / nullif(q1 - q0, 0)')} AS l_quantity,
       {R('sign(l_extendedprice) * ln(1 + abs(l_extendedprice))')} AS l_extendedprice,
       {R('(l_discount - dm) / nullif(ds, 0)')} AS l_discount, {R('least(greatest(l_tax, t0), t1)')} AS l_tax,
       {R('sign(lag_days) * ln(1 + abs(lag_days))')} AS lag_days
FROM li, fit"""
ORACLE["scaled_features"] = with_(
    EV,
    "fit AS (SELECT "
    + ", ".join(f"avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_s" for f in EVENT_VIEWS.features)
    + " FROM ev WHERE split = 'train')",
) + "SELECT record_id, split, " + ", ".join(
    f"{R(f'({f} - {f}_m) / nullif({f}_s, 0)')} AS {f}" for f in EVENT_VIEWS.features
) + " FROM ev, fit"
ORACLE["evidence_views"] = with_(EV) + " UNION ALL ".join(
    f"SELECT record_id, split, y, '{v}' AS view, '{f}' AS feature, {R(f)} AS x FROM ev" for v, f in EVENT_VIEWS.pairs
)
ORACLE["split_index"] = f"SELECT event_id AS record_id, event_type AS class, {split_sql('event_id')} AS split FROM events"
ORACLE["stratified_split"] = """
SELECT record_id, stratum, CASE WHEN pos < 60 * size THEN 'train' WHEN pos < 80 * size THEN 'validation' ELSE 'test' END AS split
FROM (SELECT event_id AS record_id, event_type AS stratum, count(*) OVER (PARTITION BY event_type) AS size,
             (row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) - 1) * 100 AS pos
      FROM events)"""
_folds = f"""
SELECT event_id AS record_id, event_type AS stratum, repeat,
       ((row_number() OVER (PARTITION BY repeat, event_type ORDER BY md5('42|' || repeat || '|' || event_id), event_id) - 1) % {CV_FOLDS})::INT AS fold
FROM events, (SELECT unnest(range(1, {CV_REPEATS + 1}))::INT AS repeat)"""
ORACLE["fold_index"] = _folds

def group_parts(shares: list[float], repeats: int) -> str:
    """Entities with a 150th of all records one by one, the others by running sums."""
    n = len(shares)
    gains = (
        f"list_transform(range(0, {n}), lambda p: round(list_sum(list_transform(range(1, len(ts) + 1), "
        "lambda c: counts[c] * lacks[p * len(ts) + c] / ts[c])), 6))"
    )
    lack = [f"greatest(lacks[{p} * len(ts) + lead], 0.0::DOUBLE)" for p in range(n)]
    some = " + ".join(f"l{p}" for p in range(n))
    ends = [" + ".join(f"CASE WHEN {some} > 0 THEN l{q} ELSE {shares[q]}::DOUBLE END" for q in range(p + 1)) for p in range(n)]
    part = " ".join(f"WHEN middle * ({ends[-1]}) < 2.0::DOUBLE * total * ({ends[p]}) THEN {p}" for p in range(n - 1))
    return f"""WITH RECURSIVE {EV},
    rec AS (SELECT record_id, entity, class, coalesce('entity:' || entity, 'record:' || record_id) AS grp FROM ev),
    cn AS (SELECT grp, coalesce(class, '') AS class, count(*) AS n FROM rec GROUP BY ALL),
    ct AS (SELECT class, sum(n)::DOUBLE AS t FROM cn GROUP BY class),
    cl AS (SELECT list(t ORDER BY class) AS ts, sum(t) AS nn FROM ct),
    pf0 AS (SELECT g.grp AS grp, list(coalesce(n, 0) ORDER BY ct.class) AS counts
            FROM (SELECT DISTINCT grp FROM cn) AS g CROSS JOIN ct LEFT JOIN cn ON cn.grp = g.grp AND cn.class = ct.class GROUP BY g.grp),
    pf1 AS (SELECT *, list_sum(counts)::BIGINT AS size, list_transform(range(1, len(ts) + 1), lambda i: counts[i] / ts[i]) AS sh FROM pf0, cl),
    pf AS (SELECT *, list_position(sh, list_max(sh)) AS lead, size * 150 >= nn AS large, length(bin(size)) AS oos, repeat,
                  md5('{SEED}|' || repeat || '|' || grp) AS h FROM pf1, (SELECT unnest(range(1, {repeats + 1}))::INT AS repeat)),
    lg AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY oos DESC, h, grp) AS i FROM pf WHERE large),
    pl AS (SELECT repeat, 0::BIGINT AS i, list_concat({', '.join(f'list_transform(ts, lambda t: t * {x!r}::DOUBLE)' for x in shares)}) AS lacks,
                  NULL::VARCHAR AS grp, NULL::BIGINT AS part FROM cl, (SELECT unnest(range(1, {repeats + 1}))::INT AS repeat)
           UNION ALL
           SELECT repeat, i, list_transform(range(1, len(lacks) + 1), lambda j: CASE WHEN (j - 1) // len(ts) = b THEN lacks[j] - counts[(j - 1) % len(ts) + 1] ELSE lacks[j] END),
                  grp, b FROM (
             SELECT lg.repeat, lg.i, lacks, ts, counts, lg.grp, list_position(w, list_max(w)) - 1 AS b FROM (
               SELECT lg.*, lacks, {gains} AS w FROM pl JOIN lg ON lg.repeat = pl.repeat AND lg.i = pl.i + 1) AS lg)),
    la AS (SELECT repeat, arg_max(lacks, i) AS lacks FROM pl GROUP BY repeat),
    sm AS (SELECT pf.*, lacks, 2 * sum(size) OVER (PARTITION BY pf.repeat, lead, oos ORDER BY h, grp) - size AS middle,
                  sum(size) OVER (PARTITION BY pf.repeat, lead, oos) AS total FROM pf JOIN la ON la.repeat = pf.repeat WHERE NOT large),
    sl AS (SELECT *, {', '.join(f'{c} AS l{p}' for p, c in enumerate(lack))} FROM sm),
    pt AS (SELECT repeat, grp, part FROM pl WHERE i > 0 UNION ALL SELECT repeat, grp, CASE {part} ELSE {n - 1} END FROM sl)
    """


ORACLE["group_split"] = group_parts([0.6, 0.2, 0.2], 1) + (
    "SELECT record_id, entity, class, ['train', 'validation', 'test'][part + 1] AS split FROM rec JOIN pt ON rec.grp = pt.grp"
)
ORACLE["group_folds"] = group_parts([1.0 / CV_FOLDS] * CV_FOLDS, CV_REPEATS) + (
    "SELECT record_id, repeat, part::INT AS fold FROM rec JOIN pt ON rec.grp = pt.grp"
)

ORACLE["seeded_buckets"] = (
    f"SELECT event_id, {bucket('event_id')} AS bucket_a, {bucket('event_id', seed=7)} AS bucket_b FROM events"
)

# ---- description ------------------------------------------------------------

_doc_cols = ["text", "n_chars", "n_words", "y", "toxic"]
ORACLE["dataset_assessment"] = with_(DOC) + " UNION ALL ".join(
    f"""SELECT dataset, '{c}' AS "column", count(*) AS rows, (count(*) - count({c}))::BIGINT AS nulls,
        {f"count(*) FILTER (WHERE NOT isfinite({c}))" if c in ('n_chars', 'n_words', 'toxic') else '0::BIGINT'} AS non_finite,
        count(DISTINCT {c}) AS "distinct" FROM doc GROUP BY dataset"""
    for c in _doc_cols
) + """ UNION ALL
SELECT dataset, '*', sum(c)::BIGINT, 0::BIGINT, 0::BIGINT, count(*) FROM (
  SELECT dataset, text, n_chars, n_words, n_lines, y, toxic, count(*) AS c FROM doc GROUP BY ALL) GROUP BY dataset"""
ORACLE["assessment_by_parts"] = (
    f'SELECT dataset, "column", rows, nulls, non_finite, true AS distinct_within FROM ({ORACLE["dataset_assessment"]})'
)
ORACLE["feature_statistics"] = with_(LI) + " UNION ALL ".join(
    f"SELECT dataset, '{f}' AS feature, count({f}) AS n, {R(f'avg({f})', 4)} AS mean, {R(f'stddev_samp({f})', 4)} AS sd, "
    f"{R(f'min({f})', 4)} AS min, {R(f'max({f})', 4)} AS max, "
    + ", ".join(f"{R(f'quantile_cont({f}, {q})', 4)} AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    + " FROM li GROUP BY dataset"
    for f in LINE_VIEWS.features
)
ORACLE["class_shares"] = with_(LI) + (
    f"SELECT dataset, split, class, n, {R('n / sum(n) OVER (PARTITION BY dataset, split)')} AS share "
    "FROM (SELECT dataset, split, class, count(*) AS n FROM li GROUP BY ALL)"
)

# ---- sources and sinks ------------------------------------------------------

ORACLE["csv_flows"] = "SELECT event_id AS record_id, user_id, event_type, value, props, epoch_us(ts) AS ts_us FROM events"
ORACLE["csv_datasets"] = (
    f"SELECT {LINE_KEY} AS record_id, l_linestatus AS dataset, l_extendedprice, l_quantity FROM lineitem"
)
ORACLE["written_splits"] = with_(LI) + (
    "SELECT split, dataset, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM li GROUP BY ALL"
)
ORACLE["written_predictions"] = with_(*LIC) + " UNION ALL ".join(
    f"SELECT record_id, dataset, '{v}' AS view, {R(f'p_{v}')} AS score FROM scored" for v in _names
)
ORACLE["bucketed_evidence"] = with_(*LIC) + (
    "SELECT record_id, dataset, split, " + ", ".join(f"{R(f'p_{v}')} AS p_{v}" for v in _names) + " FROM scored"
)
ORACLE["saved_parameters"] = with_(*EVC) + (
    "SELECT record_id, " + ", ".join(f"{R(f'p_{v}')} AS p_{v}" for v in EVENT_VIEWS.names) + " FROM scored"
)
ORACLE["appended_run_log"] = """
SELECT event_id::VARCHAR AS run_id, event_type AS stage, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS rows,
       value AS seconds, epoch_us(ts) AS started_us FROM events"""

# ---- evaluation -------------------------------------------------------------

ORACLE["confusion_rates"] = with_(
    *LIT, f"pr AS (SELECT dataset, y, coalesce(s >= theta, false)::INT AS pred FROM ft)",
    """cf AS (SELECT dataset, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn
             FROM pr GROUP BY dataset)""",
    f"rt AS (SELECT *, {RATE_COLS} FROM cf)",
) + "SELECT dataset, tp, fp, tn, fn, " + ", ".join(
    f'{R(chr(34) + m + chr(34))} AS "{m}"' for m in RATE_NAMES
) + " FROM rt"
ORACLE["ranking_auc"] = with_(
    *LIA, f"vl AS ({variants(LINE_VIEWS, 'aw', 'split, y', gr(LINE_VIEWS, FIT))})",
    f"""rk AS (SELECT variant, split, y, rank() OVER (PARTITION BY variant, split ORDER BY k)
                + (count(*) OVER (PARTITION BY variant, split, k) - 1) / 2 AS r
             FROM (SELECT *, coalesce(s, -1.0::DOUBLE) AS k FROM vl))""",
) + f"""
SELECT variant, split, {R('''(sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
       / nullif(count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)::DOUBLE, 0)''')} AS auc
FROM rk GROUP BY variant, split"""

_cl_params, _logits = [], []
for _j, _c in enumerate(EVENT_CLASSES):
    _cl_params.append(f"count(*) FILTER (WHERE class = '{_c}') AS n{_j}")
    for _f in EVENT_VIEWS.features:
        _cl_params.append(f"avg({_f}) FILTER (WHERE class = '{_c}') AS {_f}__m{_j}")
        _cl_params.append(f"greatest(var_samp({_f}) FILTER (WHERE class = '{_c}'), 1e-9) AS {_f}__v{_j}")
    _logits.append(
        f"ln(n{_j}::DOUBLE) + "
        + " + ".join(
            f"coalesce(-0.5::DOUBLE * ln({_f}__v{_j}) - ({_f} - {_f}__m{_j}) * ({_f} - {_f}__m{_j}) / (2 * {_f}__v{_j}), 0.0::DOUBLE)"
            for _f in EVENT_VIEWS.features
        )
        + f" AS l{_j}"
    )
_best = "greatest(" + ", ".join(f"l{j}" for j in range(len(EVENT_CLASSES))) + ")"
ORACLE["class_metrics"] = with_(
    EV,
    f"cp AS (SELECT {', '.join(_cl_params)} FROM ev WHERE split = 'train')",
    f"lg AS (SELECT class, {', '.join(_logits)} FROM ev, cp WHERE split = 'test')",
    "pd AS (SELECT class, CASE " + " ".join(f"WHEN l{j} = {_best} THEN '{c}'" for j, c in enumerate(EVENT_CLASSES)) + " END AS yhat FROM lg)",
    "cls AS (SELECT class FROM pd UNION SELECT yhat FROM pd)",
    """pc AS (SELECT c.class, (SELECT count(*) FROM pd WHERE pd.class = c.class) AS support,
                  (SELECT count(*) FROM pd WHERE yhat = c.class) AS predicted,
                  (SELECT count(*) FROM pd WHERE pd.class = c.class AND yhat = c.class) AS hits FROM cls c)""",
) + f"""
SELECT class, support, predicted, hits, {R('hits / nullif(predicted, 0)')} AS "precision",
       {R('hits / nullif(support, 0)')} AS recall, {R('2 * hits / nullif(predicted + support, 0)')} AS f1 FROM pc"""

_vv = [
    *VT,
    "ste AS (SELECT * FROM aw WHERE split = 'test')",
    f"tl0 AS ({variants(LINE_VIEWS, 'ste', 'y', gr(LINE_VIEWS, FIT))})",
    "tl AS (SELECT tl0.*, theta FROM tl0 LEFT JOIN vt USING (variant))",
    f"vm AS ({metrics('tl', 'variant, theta')})",
]
ORACLE["view_validation"] = with_(*_vv) + f"SELECT {metric_list('variant')}, {R('theta')} AS theta FROM vm"


# Poisson counts of mean 1 from their distribution function, written as a sum over its steps.
_poisson = " + ".join(
    f"(u >= exp(-1.0::DOUBLE) * list_sum([1.0::DOUBLE / factorial(i::INTEGER) FOR i IN range(0, {k + 1})]))::INT" for k in range(9)
)
ORACLE["bootstrap_intervals"] = with_(
    *LIA,
    f"bv0 AS ({variants(LINE_VIEWS, 'aw', 'split, entity, y', gr(LINE_VIEWS, FIT))})",
    f"bb AS (SELECT variant, {bucket('entity', buckets=512)} AS block, count(*) AS n, sum((s - y) * (s - y)) AS t FROM bv0 WHERE split = 'test' AND s IS NOT NULL AND y IS NOT NULL GROUP BY ALL)",
    f"bu AS (SELECT block, draw, ('0x' || substr(md5('{SEED}|' || draw || '|' || block), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(0, 512) x(block), range(1, 401) z(draw))",
    f"bw AS (SELECT block, draw, {_poisson} AS w FROM bu)",
    "bm AS (SELECT variant, draw, sum(w * t) / nullif(sum(w * n), 0)::DOUBLE AS m FROM bb JOIN bw USING (block) GROUP BY ALL)",
    "bo AS (SELECT variant, sum(n)::BIGINT AS n, sum(t) / sum(n)::DOUBLE AS mean FROM bb GROUP BY ALL)",
    "bq AS (SELECT variant, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY ALL)",
) + f"SELECT variant, n, {R('mean')} AS mean, {R('se')} AS se, {R('low')} AS low, {R('high')} AS high FROM bo JOIN bq USING (variant)"

# DeLong's components from midranks over all records and over those of a class.
_z95 = "1.959963984540054::DOUBLE"


def _components(src: str, by: str) -> str:
    return f"""SELECT *, ((below + same / 2.0::DOUBLE) / others) AS v FROM (
      SELECT *, CASE y WHEN 1 THEN n_below ELSE n_pos - p_below - p_same END AS below, CASE y WHEN 1 THEN n_same ELSE p_same END AS same,
             CASE y WHEN 1 THEN n_neg ELSE n_pos END AS others
      FROM (SELECT *, count(*) FILTER (WHERE y = 0) OVER lo - n_same AS n_below, count(*) FILTER (WHERE y = 1) OVER lo - p_same AS p_below
            FROM (SELECT *, count(*) FILTER (WHERE y = 0) OVER eq AS n_same, count(*) FILTER (WHERE y = 1) OVER eq AS p_same,
                         count(*) FILTER (WHERE y = 0) OVER al AS n_neg, count(*) FILTER (WHERE y = 1) OVER al AS n_pos
                  FROM (SELECT * REPLACE (coalesce(s, -1.0::DOUBLE) AS s) FROM {src} WHERE y IS NOT NULL)
                  WINDOW eq AS (PARTITION BY {by}, s), al AS (PARTITION BY {by}))
            WINDOW lo AS (PARTITION BY {by} ORDER BY s)))"""


_dl = f"({variants(LINE_VIEWS, 'aw', 'record_id, split, y', gr(LINE_VIEWS, FIT))})"
DELONG = [*LIA, f"dv0 AS {_dl}", f"dv AS ({_components('dv0', 'variant, split')})"]
ORACLE["auc_intervals"] = with_(
    *DELONG,
    """da AS (SELECT variant, split, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg,
       avg(v) FILTER (WHERE y = 1) AS auc, sqrt(var_samp(v) FILTER (WHERE y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)
       + var_samp(v) FILTER (WHERE y = 0) / nullif(count(*) FILTER (WHERE y = 0), 0)) AS se FROM dv GROUP BY variant, split)""",
) + f"""SELECT variant, split, n_pos, n_neg, {R('auc')} AS auc, {R('se')} AS se,
       {R(f'greatest(auc - {_z95} * se, 0.0::DOUBLE)')} AS low, {R(f'least(auc + {_z95} * se, 1.0::DOUBLE)')} AS high FROM da"""
# The variance of a difference from both variances and the covariance.
ORACLE["auc_differences"] = with_(
    *DELONG,
    """dp AS (SELECT b.variant AS versus, a.y, a.v AS va, b.v AS vb FROM dv a JOIN dv b USING (record_id)
       WHERE a.variant = 'reliability' AND b.variant <> 'reliability' AND a.split = 'test')""",
    """dc AS (SELECT versus, y, count(*) AS n, avg(va) AS ma, avg(vb) AS mb,
       greatest(var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb), 0.0::DOUBLE) AS var FROM dp GROUP BY versus, y)""",
    """dd AS (SELECT versus, max(n) FILTER (WHERE y = 1) AS n_pos, max(n) FILTER (WHERE y = 0) AS n_neg,
       max(ma) FILTER (WHERE y = 1) AS auc, max(mb) FILTER (WHERE y = 1) AS auc_versus, sqrt(sum(var / n)) AS se FROM dc GROUP BY versus)""",
) + f"""SELECT versus, n_pos, n_neg, {R('auc')} AS auc, {R('auc_versus')} AS auc_versus, {R('se')} AS se,
       {R('auc - auc_versus')} AS difference, {R(f'auc - auc_versus - {_z95} * se')} AS low,
       {R(f'auc - auc_versus + {_z95} * se')} AS high,
       {R('CASE WHEN se > 1e-7 THEN (auc - auc_versus) / se END', 3)} AS z FROM dd"""


def tree_ctes(spec: ViewSpec, base: str, bins: int = 16, depth: int = 3, least: int = 20) -> list[str]:
    """``tn`` (nodes) and ``scored`` (leaf scores of every record), from ``train`` and ``base``."""
    edges, cells = [], []
    for f in spec.features:
        at = lambda edge: f"l[{edge}(k / {bins}.0::DOUBLE * (len(l) - 1))::BIGINT + 1]"
        share = f"(k / {bins}.0::DOUBLE * (len(l) - 1) - floor(k / {bins}.0::DOUBLE * (len(l) - 1)))"
        edges.append(
            f"te_{f} AS (SELECT [{at('floor')} + {share} * ({at('ceil')} - {at('floor')}) FOR k IN range(1, {bins})] AS e_{f} "
            f"FROM (SELECT coalesce(list({f} ORDER BY {f}) FILTER (WHERE {f} IS NOT NULL), []) AS l FROM train WHERE y IS NOT NULL))"
        )
        cells.append(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 + len([e FOR e IN e_{f} IF e < {f}]) END AS c_{f}")
    tables = ", ".join(f"te_{f}" for f in spec.features)
    out = [*edges, f"tb AS (SELECT record_id, split, y, {', '.join(cells)} FROM {base}, {tables})"]
    views = " UNION ALL ".join(
        f"SELECT record_id, split, y, '{v}' AS view, [{', '.join(f'c_{f}' for f in fs)}] AS c, 1 AS node "
        f"FROM tb WHERE greatest({', '.join(f'c_{f}' for f in fs)}) > 0"
        for v, fs in spec.views.items()
    )
    out.append(f"tl_0 AS ({views})")
    for k in range(depth):
        out += [
            f"""th_{k} AS (SELECT view, node, f, cell, count(*) AS n, sum(y)::BIGINT AS p
              FROM (SELECT view, node, y, unnest(range(len(c))) AS f, unnest(c) AS cell FROM tl_{k}
                    WHERE split = 'train' AND y IS NOT NULL AND node >= {2**k}) GROUP BY ALL)""",
            f"""tc_{k} AS (SELECT view, node, f, cell AS cut, sum(n) OVER w AS nl, sum(p) OVER w AS pl,
              sum(n) OVER a AS n, sum(p) OVER a AS p FROM th_{k}
              WINDOW w AS (PARTITION BY view, node, f ORDER BY cell), a AS (PARTITION BY view, node, f))""",
            f"""ts_{k} AS (SELECT view, node, f, cut, gain FROM (
              SELECT *, row_number() OVER (PARTITION BY view, node ORDER BY gain DESC, f, cut) AS pick FROM (
                SELECT *, pl::DOUBLE * pl::DOUBLE / nl::DOUBLE + (p - pl)::DOUBLE * (p - pl)::DOUBLE / (n - nl)::DOUBLE
                          - p::DOUBLE * p::DOUBLE / n::DOUBLE AS gain FROM tc_{k} WHERE nl >= {least} AND n - nl >= {least})
              WHERE gain > 1e-6) WHERE pick = 1)""",
            f"""tl_{k + 1} AS (SELECT t.* REPLACE (CASE WHEN s.f IS NULL THEN t.node
              ELSE t.node * 2 + (t.c[s.f + 1] > s.cut)::INT END AS node) FROM tl_{k} t LEFT JOIN ts_{k} s USING (view, node))""",
        ]
    splits = " UNION ALL ".join(f"SELECT * FROM ts_{k}" for k in range(depth))
    levels = " UNION ALL ".join(
        f"SELECT view, node, y FROM tl_{k} WHERE split = 'train' AND y IS NOT NULL AND node >= {2**k}" for k in range(depth + 1)
    )
    feature = " ".join(f"WHEN view = '{v}' AND f = {j} THEN '{f}'" for v, fs in spec.views.items() for j, f in enumerate(fs))
    edge = " ".join(f"WHEN '{f}' THEN CASE WHEN cut > 0 THEN e_{f}[cut] END" for f in spec.features)
    leaves = ", ".join(f"max(score) FILTER (WHERE view = '{v}') AS p_{v}" for v in spec.names)
    return [
        *out,
        f"tt AS (SELECT view, node, count(*) AS n, sum(y)::BIGINT AS p, (sum(y) + 1)::DOUBLE / (count(*) + 2)::DOUBLE AS score "
        f"FROM ({levels}) GROUP BY ALL)",
        f"tn0 AS (SELECT tt.*, f, cut, gain, CASE {feature} END AS feature FROM tt LEFT JOIN ({splits}) USING (view, node))",
        f"tn AS (SELECT tn0.*, CASE feature {edge} END AS threshold FROM tn0, {tables})",
        f"sc AS (SELECT record_id, {leaves} FROM tl_{depth} JOIN tt USING (view, node) GROUP BY record_id)",
        f"scored AS (SELECT b.*, {', '.join(f'p_{v}' for v in spec.names)} FROM {base} b LEFT JOIN sc USING (record_id))",
    ]


TREES = [*LIC[:2], *tree_ctes(LINE_VIEWS, "li")]
ORACLE["tree_nodes"] = with_(*TREES) + (
    f"SELECT view, node::BIGINT AS node, n, p, feature, {R('threshold')} AS threshold, {R('gain')} AS gain, {R('score')} AS score FROM tn"
)
ORACLE["tree_predictions"] = with_(*TREES) + (
    "SELECT record_id, " + ", ".join(f"{R(f'p_{v}')} AS p_{v}" for v in LINE_VIEWS.names) + " FROM scored"
)
ORACLE["tree_validation"] = with_(*TREES, *_vv[4:]) + f"SELECT {metric_list('variant')}, {R('theta')} AS theta FROM vm"

# Fixed values, written out: component switches (integrity, quality, time, weights, left out).
_switches = [
    ("full", "iqt", True, ""),
    ("no_integrity", "qt", True, ""),
    ("no_quality", "it", True, ""),
    ("no_temporal", "iq", True, ""),
    ("no_reliability", "", True, ""),
    ("no_weights", "iqt", False, ""),
    ("unweighted", "", False, ""),
    ("without:volume", "iqt", True, "volume"),
    ("without:terms", "iqt", True, "terms"),
    ("without:timing", "iqt", True, "timing"),
]
_ab = []
for _variant, _on, _g, _without in _switches:
    _wt = {}
    for _n in _names:
        if _without == _n:
            _wt[_n] = "0.0::DOUBLE"
            continue
        _terms = " + ".join(f"a_{k} * {c}" for k, c in zip("iqt", ("i", f"q_{_n}", "t")) if k in _on)
        _base = " + ".join(f"a_{k}" for k in _on)
        _r = f"coalesce(({_terms}) / nullif({_base}, 0), 1.0::DOUBLE)" if _on else "1.0::DOUBLE"
        _wt[_n] = (f"g_{_n} * " if _g else "") + _r
    _ab.append(f"SELECT '{_variant}' AS variant, split, y, {fused(LINE_VIEWS, _wt)} AS s FROM aw")
_ablation = [
    *LIA,
    f"ab AS ({' UNION ALL '.join(_ab)})",
    "abv AS (SELECT * FROM ab WHERE split = 'validation')",
    f"abt AS ({theta('abv', 'variant')})",
    "abl AS (SELECT ab.*, theta FROM ab LEFT JOIN abt USING (variant) WHERE split = 'test')",
    f"am AS ({metrics('abl', 'variant, theta')})",
]
ORACLE["component_ablation"] = with_(*_ablation) + f"SELECT {metric_list('variant')}, {R('theta')} AS theta FROM am"

_hit_a = f"({bucket(chr(39) + 'amount' + chr(39), 'record_id', buckets=1000)} < 0.3::DOUBLE * 1000)"
_hit_t = f"({bucket(chr(39) + 'timing' + chr(39), 'record_id', buckets=1000)} < 0.5::DOUBLE * 1000)"
_noise = f"60.0::DOUBLE * (2 * ({bucket(chr(39) + 'gap' + chr(39), 'record_id', buckets=1000000)} / 1e6) - 1)"
ORACLE["degraded_evidence"] = with_(
    EV,
    f"dg AS (SELECT record_id, CASE WHEN NOT {_hit_a} THEN value END AS value, k, CASE WHEN {_hit_t} THEN gap + {_noise} ELSE gap END AS gap FROM ev)",
) + f"SELECT record_id, {R('value')} AS value, {R('k')} AS k, {R('gap')} AS gap, (value IS NOT NULL)::INT::DOUBLE AS q_amount FROM dg"

# Half width of the uniform noise of each feature.
_WIDTHS = {"l_quantity": 25.0, "l_extendedprice": 40000.0, "l_discount": 0.05, "l_tax": 0.04, "lag_days": 60.0}
_shift = {f: f"{w}::DOUBLE * (2 * ({bucket(chr(39) + f + chr(39), 'record_id', buckets=1000000)} / 1e6) - 1)" for f, w in _WIDTHS.items()}


def _degraded(noise: bool) -> str:
    out = []
    for v, fs in LINE_VIEWS.views.items():
        new = lambda f: f"CASE WHEN hit THEN {f} + {_shift[f]} ELSE {f} END" if noise else f"CASE WHEN NOT hit THEN {f} END"
        cols = ", ".join(f"{new(f)} AS {f}" if f in fs else f for f in LINE_VIEWS.features)
        out.append(
            f"SELECT record_id, y, i, t, '{v}' AS view, rate, {cols} FROM (SELECT li.*, rate, "
            f"{bucket(chr(39) + v + chr(39), 'record_id', buckets=1000)} < rate * 1000 AS hit "
            f"FROM li, (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RATES)}]) AS rate) WHERE split = 'test')"
        )
    return " UNION ALL ".join(out)


_w_fit = gr(LINE_VIEWS, FIT)
EVENT_ALL, LINE_ALL = (ViewSpec({"all": tuple(v.features)}) for v in (EVENT_VIEWS, LINE_VIEWS))
_curve = lambda noise: with_(
    *VT,
    f"dg AS ({_degraded(noise)})",
    *newton(LINE_VIEWS, "train", "par"),
    f"ds AS (SELECT b.*, {q_cols(LINE_VIEWS)}, {p_cols(LINE_VIEWS)}, {p_cols(LINE_ALL)}, {p_logistic(LINE_VIEWS)} FROM dg b, par P, ls, lb)",
    f"bl0 AS (SELECT b.y, {p_cols(LINE_ALL)}, {p_logistic(LINE_VIEWS)} FROM li b, par P, ls, lb WHERE split = 'validation')",
    "bl AS (SELECT 'baseline:gaussian' AS variant, y, p_all AS s FROM bl0 UNION ALL SELECT 'baseline:logistic', y, p_logit FROM bl0)",
    f"bt AS ({theta('bl', 'variant')})",
    "dw AS (SELECT * FROM ds, wts, (SELECT a_i, a_q, a_t FROM alpha))",
    f"dl0 AS (SELECT 'unweighted' AS variant, view, rate, y, {plain(LINE_VIEWS)} AS s FROM dw "
    f"UNION ALL SELECT 'reliability', view, rate, y, {fused(LINE_VIEWS, _w_fit)} FROM dw "
    "UNION ALL SELECT 'baseline:gaussian', view, rate, y, p_all FROM dw UNION ALL SELECT 'baseline:logistic', view, rate, y, p_logit FROM dw)",
    "alt AS (SELECT variant, theta FROM vt UNION ALL SELECT variant, theta FROM bt)",
    "dl AS (SELECT dl0.*, theta FROM dl0 LEFT JOIN alt USING (variant))",
    f"dm AS ({metrics('dl', 'variant, view, rate')})",
) + (
    f"SELECT {metric_list('variant, view, rate')}, "
    f"{R('first_value(auc) OVER (PARTITION BY variant, view ORDER BY rate) - auc')} AS auc_loss, "
    f"{R('brier - first_value(brier) OVER (PARTITION BY variant, view ORDER BY rate)')} AS brier_rise FROM dm"
)
ORACLE["degradation_curve"], ORACLE["degradation_noise"] = _curve(False), _curve(True)

_cross = [
    LI,
    "tr AS (SELECT * FROM li WHERE split = 'train')",
    f"par AS ({params(LINE_VIEWS, 'tr', 'dataset')})",
    f"va AS (SELECT b.*, b.dataset AS fit_dataset, {p_cols(LINE_VIEWS)} FROM li b JOIN par P ON P.dataset = b.dataset WHERE split = 'validation')",
    f"wts AS ({weights(LINE_VIEWS, 'va', 'fit_dataset')})",
    "vaw AS (SELECT * FROM va JOIN wts USING (fit_dataset))",
    *alpha_fit(LINE_VIEWS, "vaw", "fit_dataset"),
    f"vf AS (SELECT fit_dataset, y, {fused(LINE_VIEWS, _w_fit)} AS s FROM vaw JOIN alpha USING (fit_dataset))",
    f"th AS ({theta('vf', 'fit_dataset')})",
    f"te AS (SELECT b.*, P.dataset AS fit_dataset, {p_cols(LINE_VIEWS)} FROM li b JOIN par P ON P.dataset <> b.dataset WHERE split = 'test')",
    f"tf AS (SELECT fit_dataset, dataset AS test_dataset, y, theta, {fused(LINE_VIEWS, _w_fit)} AS s "
    "FROM te JOIN wts USING (fit_dataset) JOIN alpha USING (fit_dataset) JOIN th USING (fit_dataset))",
    f"xm AS ({metrics('tf', 'fit_dataset, test_dataset, theta')})",
]
ORACLE["cross_dataset"] = with_(*_cross) + f"SELECT {metric_list('fit_dataset, test_dataset')}, {R('theta')} AS theta FROM xm"

_cv_variants = lambda src, keep: (
    variants(EVENT_VIEWS, src, keep, gr(EVENT_VIEWS, FIT))
    + f" UNION ALL SELECT {keep}, 'baseline:gaussian' AS variant, p_all AS s FROM {src}"
    + f" UNION ALL SELECT {keep}, 'baseline:logistic' AS variant, p_logit AS s FROM {src}"
)
CV = [
    EV,
    f"fo AS ({_folds})",
    "rw AS (SELECT ev.*, repeat, fold FROM ev JOIN fo USING (record_id))",
    f"mo AS (SELECT unnest(range(0, {CV_FOLDS}))::INT AS model_fold)",
    f"tr AS (SELECT rw.*, model_fold FROM rw, mo WHERE fold <> model_fold AND fold <> (model_fold + 1) % {CV_FOLDS})",
    f"par AS ({params(EVENT_VIEWS, 'tr', 'repeat, model_fold')})",
    *newton(EVENT_VIEWS, "tr", "par", "repeat, model_fold"),
    "lm AS (SELECT * FROM ls JOIN lb USING (repeat, model_fold))",
    f"va AS (SELECT b.*, P.model_fold, {p_cols(EVENT_VIEWS)}, {p_cols(EVENT_ALL)}, {p_logistic(EVENT_VIEWS)} FROM rw b JOIN par P ON P.repeat = b.repeat AND b.fold = (P.model_fold + 1) % {CV_FOLDS} JOIN lm ON lm.repeat = P.repeat AND lm.model_fold = P.model_fold)",
    f"wts AS ({weights(EVENT_VIEWS, 'va', 'repeat, model_fold')})",
    "vw0 AS (SELECT * FROM va JOIN wts USING (repeat, model_fold))",
    *alpha_fit(EVENT_VIEWS, "vw0", "repeat, model_fold"),
    "vw AS (SELECT * FROM vw0 JOIN alpha USING (repeat, model_fold))",
    f"vl AS ({_cv_variants('vw', 'y, repeat, model_fold')})",
    f"th AS ({theta('vl', 'repeat, model_fold, variant')})",
    f"te AS (SELECT b.*, P.model_fold, {p_cols(EVENT_VIEWS)}, {p_cols(EVENT_ALL)}, {p_logistic(EVENT_VIEWS)} FROM rw b JOIN par P ON P.repeat = b.repeat AND b.fold = P.model_fold JOIN lm ON lm.repeat = P.repeat AND lm.model_fold = P.model_fold)",
    "tw AS (SELECT * FROM te JOIN wts USING (repeat, model_fold) JOIN alpha USING (repeat, model_fold))",
    f"tl0 AS ({_cv_variants('tw', 'y, repeat, model_fold')})",
    "tl AS (SELECT tl0.*, theta FROM tl0 JOIN th USING (repeat, model_fold, variant))",
    f"cm AS ({metrics('tl', 'repeat, model_fold, variant')})",
    "sco AS ("
    + " UNION ALL ".join(
        f"SELECT variant AS model, repeat, model_fold AS fold, '{m}' AS metric, ({m})::DOUBLE AS value FROM cm"
        for m in ("accuracy", "auc", "brier", "f1")
    )
    + ")",
]
ORACLE["cv_scores"] = with_(*CV) + f"SELECT model, repeat, fold, metric, {R('value')} AS value FROM sco"

ORACLE["baseline_gaussian"] = with_(
    *LIC[:3],
    f"bs AS (SELECT 'gaussian' AS variant, split, y, {p_cols(LINE_ALL)} FROM li b, par P)",
    "bg AS (SELECT variant, split, y, p_all AS s FROM bs)",
    "bv AS (SELECT * FROM bg WHERE split = 'validation')",
    f"bt AS ({theta('bv', 'variant')})",
    "be AS (SELECT bg.*, theta FROM bg LEFT JOIN bt USING (variant) WHERE split = 'test')",
    f"bm AS ({metrics('be', 'variant, theta')})",
) + f"SELECT {metric_list('variant')}, {R('theta')} AS theta FROM bm"

ORACLE["logistic_coefficients"] = with_(*LIC[:3], *newton(LINE_VIEWS, "train", "par")) + " UNION ALL ".join(
    f"SELECT '{t}' AS term, {R(f'b{j}')} AS b FROM lb" for j, t in enumerate(["(intercept)", *LINE_VIEWS.features])
)
ORACLE["baseline_logistic"] = with_(
    *LIC[:3],
    *newton(LINE_VIEWS, "train", "par"),
    f"bg0 AS (SELECT 'logistic' AS variant, split, y, {p_logistic(LINE_VIEWS)} FROM li b, ls, lb)",
    "bg AS (SELECT variant, split, y, p_logit AS s FROM bg0)",
    "bv AS (SELECT * FROM bg WHERE split = 'validation')",
    f"bt AS ({theta('bv', 'variant')})",
    "be AS (SELECT bg.*, theta FROM bg LEFT JOIN bt USING (variant) WHERE split = 'test')",
    f"bm AS ({metrics('be', 'variant, theta')})",
) + f"SELECT {metric_list('variant')}, {R('theta')} AS theta FROM bm"

# ---- statistics -------------------------------------------------------------

_summary = f"""
sm AS (SELECT model, metric, n, mean, sd, median, mean - b * sd / sqrt(n) AS ci_low, mean + b * sd / sqrt(n) AS ci_high
       FROM (SELECT model, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS median
             FROM sco GROUP BY ALL) LEFT JOIN tb USING (n))"""
# Fixed value: two-sided 95 % point of Student's distribution for 15 scores.
_bound = "tb AS (SELECT 15 AS n, 2.1447866879169273::DOUBLE AS b)"
ORACLE["score_summary"] = with_(*CV, _bound, _summary) + "SELECT model, metric, n, " + ", ".join(
    f"{R(c)} AS {c}" for c in ("mean", "sd", "median", "ci_low", "ci_high")
) + " FROM sm"
DIFF = [
    *CV,
    """df AS (SELECT b.model AS versus, metric, repeat, fold, a.value AS value_a, b.value AS value_b, a.value - b.value AS diff
       FROM sco a JOIN sco b USING (metric, repeat, fold) WHERE a.model = 'reliability' AND b.model IN ('unweighted', 'baseline:gaussian', 'baseline:logistic'))""",
]
ORACLE["paired_differences"] = with_(*DIFF) + (
    f"SELECT versus, metric, repeat, fold, {R('value_a')} AS value_a, {R('value_b')} AS value_b, {R('diff')} AS diff FROM df"
)


def _student(t: str, df: str) -> str:
    """Two-sided p-value by Simpson's rule over powers of the cosine."""
    area = lambda top: (
        f"({top}) * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1.0::DOUBLE "
        f"WHEN k % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * pow(cos(({top}) * k / 2000.0::DOUBLE), {df} - 1)))"
    )
    return f"1.0::DOUBLE - {area(f'atan(abs({t}) / sqrt({df}))')} / ({area('pi() / 2')})"


ORACLE["paired_t_test"] = with_(
    *DIFF,
    "pt AS (SELECT versus, metric, count(diff) AS n, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff FROM df GROUP BY versus, metric)",
    "pu AS (SELECT *, CASE WHEN sd_diff > 1e-12 THEN sd_diff END AS sd0 FROM pt)",
) + (
    f"SELECT versus, metric, n, {R('mean_diff', 5)} AS mean_diff, {R('sd_diff', 5)} AS sd_diff, "
    f"{R('mean_diff / (sd0 / sqrt(n))', 5)} AS t, {R('mean_diff / sd0', 5)} AS effect_size, {R(_student('mean_diff / (sd0 / sqrt(n))', 'n - 1'), 5)} AS p FROM pu"
)
ORACLE["adjusted_tests"] = with_(
    *DIFF,
    "pt AS (SELECT versus, metric, count(diff) AS n, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff FROM df GROUP BY versus, metric)",
    f"""pp AS (SELECT *, CASE WHEN sd_diff > 1e-12 THEN greatest({_student('mean_diff / (sd_diff / sqrt(n))', 'n - 1')}, 0.0::DOUBLE) END AS p FROM pt)""",
    # Written as a maximum over all tests that are not larger.
    """ph AS (SELECT a.versus, a.metric, max(least(b.p * (SELECT count(*) FROM pp c WHERE c.metric = b.metric AND (c.p, c.versus) >= (b.p, b.versus)), 1.0::DOUBLE)) AS p_holm
       FROM pp a JOIN pp b ON a.metric = b.metric AND (b.p, b.versus) <= (a.p, a.versus) GROUP BY a.versus, a.metric)""",
) + f"""SELECT versus, metric, n, {R('mean_diff', 5)} AS mean_diff, {R('p', 5)} AS p, {R('p_holm', 5)} AS p_holm
       FROM pp LEFT JOIN ph USING (versus, metric)"""
# Ranks by counting the models above and beside; the tail of the chi-square distribution by Simpson's rule over u, x = u^2.
ORACLE["friedman_test"] = with_(
    *CV,
    "fv0 AS (SELECT metric, repeat, fold, model, round(value, 9) AS v FROM sco WHERE value IS NOT NULL)",
    "fk AS (SELECT metric, count(DISTINCT model) AS k FROM fv0 GROUP BY metric)",
    "fb AS (SELECT metric, repeat, fold, k FROM fv0 JOIN fk USING (metric) GROUP BY ALL HAVING count(*) = k)",
    """fr AS (SELECT a.metric, repeat, fold, a.model, k, 0.5::DOUBLE + sum(CASE WHEN b.v > a.v THEN 1.0::DOUBLE WHEN b.v = a.v THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS r
       FROM fv0 a JOIN fb USING (metric, repeat, fold) JOIN fv0 b USING (metric, repeat, fold) GROUP BY ALL)""",
    "fm AS (SELECT metric, model, k, count(*) AS n, avg(r) AS mean_rank, sum(r * r) AS sq FROM fr GROUP BY ALL)",
    """fc AS (SELECT metric, (k - 1) * sum((n * mean_rank - n * (k + 1) / 2) * (n * mean_rank - n * (k + 1) / 2))
              / CASE WHEN abs(sum(sq) - n * k * (k + 1) * (k + 1) / 4) > 1e-9 THEN sum(sq) - n * k * (k + 1) * (k + 1) / 4 END AS chi FROM fm GROUP BY metric, k, n)""",
    """fp AS (SELECT metric, chi, 1.0::DOUBLE - least(list_sum(list_transform(range(0, 20001), lambda j:
              CASE WHEN j IN (0, 20000) THEN 1.0::DOUBLE WHEN j % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END
              * pow(j * sqrt(chi) / 20000.0::DOUBLE, k - 2) * exp(-pow(j * sqrt(chi) / 20000.0::DOUBLE, 2) / 2)))
              * sqrt(chi) / 20000.0::DOUBLE / 3 / pow(2.0::DOUBLE, (k - 1) / 2.0::DOUBLE - 1) / gamma((k - 1) / 2.0::DOUBLE), 1.0::DOUBLE) AS p FROM fc JOIN fk USING (metric))""",
) + f"""SELECT metric, model, n, k AS models, {R('mean_rank', 5)} AS mean_rank, {R('chi', 5)} AS chi_square, {R('p', 5)} AS p
       FROM fm LEFT JOIN fp USING (metric)"""
ORACLE["signed_rank_test"] = with_(
    *DIFF,
    "nz AS (SELECT versus, metric, round(diff, 9) AS d FROM df WHERE round(diff, 9) <> 0)",
    """rk AS (SELECT versus, metric, d, count(*) OVER (PARTITION BY versus, metric, abs(d)) AS t,
           rank() OVER (PARTITION BY versus, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY versus, metric, abs(d)) - 1) / 2 AS r FROM nz)""",
    """sr AS (SELECT versus, metric, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus,
           coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus FROM rk GROUP BY versus, metric)""",
    """tg AS (SELECT versus, metric, sum(t * t * t - t)::DOUBLE AS ties
           FROM (SELECT versus, metric, abs(d) AS a, count(*) AS t FROM nz GROUP BY ALL) GROUP BY versus, metric)""",
) + (
    f"SELECT versus, metric, n, {R('w_plus')} AS w_plus, {R('w_minus')} AS w_minus, {R('least(w_plus, w_minus)')} AS w, "
    f"{R('(w_plus - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0)')} AS z FROM sr JOIN tg USING (versus, metric)"
)
ORACLE["permutation_test"] = with_(
    *DIFF,
    "ob AS (SELECT versus, metric, count(diff) AS n, avg(diff) AS mean_diff FROM df GROUP BY versus, metric)",
    f"""pm AS (SELECT versus, metric, b, avg(CASE WHEN ('0x' || substr(md5('42|' || b || '|' || repeat || '|' || fold), 1, 1))::INT < 8 THEN diff ELSE -diff END) AS m
           FROM df, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS b) GROUP BY ALL)""",
    """ex AS (SELECT versus, metric, n, mean_diff, count(*) FILTER (WHERE round(abs(m), 9) >= round(abs(mean_diff), 9)) AS extreme
           FROM pm JOIN ob USING (versus, metric) GROUP BY ALL)""",
) + f"SELECT versus, metric, n, {R('mean_diff')} AS mean_diff, extreme, {R(f'(extreme + 1) / {PERMUTATIONS + 1}.0::DOUBLE')} AS p FROM ex"

LOG = """
lg AS (SELECT event_type AS stage, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS rows, value AS seconds FROM events)"""
ORACLE["efficiency_table"] = with_(LOG) + f"""
SELECT stage, count(*) AS runs, sum(rows)::BIGINT AS total_rows, {R('sum(seconds)', 4)} AS total_seconds,
       {R('quantile_cont(seconds, 0.5)', 4)} AS median_seconds, {R('quantile_cont(seconds, 0.95)', 4)} AS p95_seconds,
       {R('sum(rows)::DOUBLE / nullif(sum(seconds), 0)', 4)} AS rows_per_second FROM lg GROUP BY stage"""
ORACLE["scalability_table"] = with_(
    LOG, "sz AS (SELECT stage, rows, count(*) AS runs, avg(seconds) AS mean_seconds FROM lg GROUP BY ALL)"
) + f"""
SELECT stage, rows, runs, {R('mean_seconds', 9)} AS mean_seconds, {R('rows / nullif(mean_seconds, 0)', 9)} AS rows_per_second,
       {R('rows::DOUBLE / nullif(lag(rows) OVER w, 0)', 9)} AS size_ratio,
       {R('mean_seconds / nullif(lag(mean_seconds) OVER w, 0)', 9)} AS time_ratio
FROM sz WINDOW w AS (PARTITION BY stage ORDER BY rows)"""

# ---- consolidation ----------------------------------------------------------


def results_of(sql: str, experiment: int, output: str, dataset: str, subject: str, names: list[str]) -> str:
    body = " UNION ALL ".join(
        f"""SELECT {dataset} AS d, {subject} AS subject, '{m}' AS m, "{m}"::DOUBLE AS v FROM ({sql})"""
        for m in names
    )
    return (
        f"SELECT '{experiment}/{output}/' || d || '/' || subject || '/' || m AS result_id, "
        f"{experiment} AS experiment, '{output}' AS output, d AS dataset, subject, m AS metric, v AS value FROM ({body})"
    )


_M = ["accuracy", "auc", "brier", "f1"]
# Results are stored unrounded. The scores of cross-validation are worked out once.
_unrounded = lambda sql: re.sub(r"::DOUBLE, \d+\) \+ 0\.0::DOUBLE", "::DOUBLE, 15) + 0.0::DOUBLE", sql)
_from_scores = lambda sql: sql.replace(",\n".join(CV), "sco AS (FROM q_cv_scores)")
_STORED = [
    ("dataset_assessment", 1, "dataset_assessment", "dataset", '"column"', ["rows", "nulls", "distinct"]),
    ("feature_statistics", 1, "descriptive_statistics", "dataset", "feature", ["mean", "sd", "p50"]),
    ("baseline_gaussian", 2, "baseline_results", "'lines'", "variant", _M),
    ("baseline_logistic", 2, "baseline_results", "'lines'", "variant", _M),
    ("view_validation", 3, "view_validation", "'lines'", "variant", _M),
    ("component_ablation", 4, "clean_ablation", "'lines'", "variant", _M),
    ("degradation_curve", 4, "degradation_comparison", "'lines'", "variant || ':' || view || ':' || rate", ["auc", "brier", "auc_loss"]),
    ("cross_dataset", 5, "cross_dataset_results", "test_dataset", "'fit:' || fit_dataset", _M),
    ("efficiency_table", 6, "efficiency_table", "'events'", "stage", ["total_seconds", "median_seconds", "p95_seconds"]),
    ("scalability_table", 6, "scalability_table", "'events'", "stage || ':' || rows", ["mean_seconds", "rows_per_second"]),
    ("cv_scores", 7, "cv_scores", "'events'", "model || ':' || metric || ':' || repeat || ':' || fold", ["value"]),
    ("score_summary", 7, "score_summary", "'events'", "model || ':' || metric", ["mean", "sd"]),
    ("paired_t_test", 7, "paired_tests", "'events'", "versus || ':' || metric", ["t", "effect_size"]),
    ("signed_rank_test", 7, "paired_tests", "'events'", "versus || ':' || metric", ["w", "z"]),
    ("permutation_test", 7, "paired_tests", "'events'", "versus || ':' || metric", ["p"]),
]
_QUERIES = {"cv_scores": _unrounded(ORACLE["cv_scores"])}
_QUERIES |= {q: _from_scores(_unrounded(ORACLE[q])) for q, *_ in _STORED if q != "cv_scores"}
_base = [f"q_{q} AS ({sql})" for q, sql in _QUERIES.items()]
_base += ["base AS (" + " UNION ALL ".join(results_of(f"FROM q_{q}", *rest) for q, *rest in _STORED) + ")"]
_ids = sorted({e for e, _, _ in EXPERIMENTS})
_matrix = "SELECT cl.claim_id AS claim_id, text, " + ", ".join(
    f"(max(n) FILTER (WHERE experiment = {e}))::DOUBLE AS experiment_{e}" for e in _ids
) + " FROM cl LEFT JOIN ev ON cl.claim_id = ev.claim_id GROUP BY cl.claim_id, text"
_claims = [
    *_base,
    f"cl AS (SELECT * FROM {values(CLAIMS, ['claim_id', 'text', 'output', 'metric'])})",
    "ev AS (SELECT claim_id, experiment, count(*) AS n FROM cl JOIN base USING (output, metric) GROUP BY ALL)",
    f"matrix AS ({_matrix})",
]
ORACLE["claims_to_evidence"] = with_(*_claims) + "FROM matrix"
_stored = results_of("FROM matrix", 8, "claims_matrix", "'claims'", "claim_id", [f"experiment_{e}" for e in _ids])
RESULTS = [*_claims, f"res AS (FROM base UNION ALL {_stored})"]
ORACLE["consolidated_results"] = with_(*RESULTS) + (
    f"SELECT result_id, experiment, output, dataset, subject, metric, {R('value')} AS value FROM res"
)
ORACLE["output_index"] = with_(
    *RESULTS, f"reg AS (SELECT * FROM {values(EXPERIMENTS, ['experiment', 'title', 'output'])})"
) + """
SELECT reg.experiment AS experiment, reg.output AS output, title, count(res.result_id) AS n_results,
       'results/' || lpad(reg.experiment::VARCHAR, 2, '0') || '/' || reg.output AS location,
       count(res.result_id) = 0 AS missing
FROM reg LEFT JOIN res ON reg.experiment = res.experiment AND reg.output = res.output
GROUP BY reg.experiment, reg.output, title"""
# The tables behind every output.
_LINES = ["lineitem", "orders"]
SOURCES = {
    "dataset_assessment": ["documents", "labels"],
    "descriptive_statistics": _LINES,
    "baseline_results": _LINES,
    "view_validation": _LINES,
    "clean_ablation": _LINES,
    "degradation_comparison": _LINES,
    "cross_dataset_results": _LINES,
    "efficiency_table": ["events"],
    "scalability_table": ["events"],
    "cv_scores": ["events"],
    "score_summary": ["events"],
    "paired_tests": ["events"],
    "claims_matrix": ["lineitem", "orders", "events"],
}
_tables = " UNION ALL ".join(f"SELECT 'table:{t}' AS source, count(*) AS source_rows FROM {t}" for t in ("lineitem", "orders", "events", "documents", "labels"))
ORACLE["result_lineage"] = with_(
    *RESULTS,
    f"so AS (SELECT * FROM {values([(o, 'table:' + t) for o, ts in SOURCES.items() for t in ts], ['output', 'source'])})",
    f"ta AS ({_tables})",
) + "SELECT result_id, source, source_rows FROM res LEFT JOIN so ON so.output = res.output LEFT JOIN ta USING (source)"
ORACLE["publication_table"] = with_(*RESULTS) + "SELECT dataset, subject, " + ", ".join(
    f"{R(f'max(value) FILTER (WHERE metric = {chr(39)}{m}{chr(39)})')} AS {m}" for m in _M
) + " FROM res WHERE output = 'clean_ablation' GROUP BY dataset, subject"


def _tree(side: str, text: str) -> list[str]:
    """CTEs: blocks of 512 bytes of each customer file, and two levels of four children."""
    level = lambda i, o: (
        f"{side}{o} AS (SELECT file, part // 4 AS part, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY part)) ELSE max(h) END AS h, "
        f"(max(n) + 3) // 4 AS n FROM {side}{i} GROUP BY file, part // 4)"
    )
    return [
        f"{side}_text AS (SELECT c_custkey // 100 AS file, 'c_custkey,c_nationkey,c_mktsegment' || chr(10) || "
        f"string_agg(c_custkey || ',' || c_nationkey || ',' || {text} || chr(10), '' ORDER BY c_custkey) AS x FROM customer GROUP BY 1)",
        f"{side}0 AS (SELECT file, part, sha256(substr(x, part * 512 + 1, 512)) AS h, n FROM "
        f"(SELECT file, x, n, unnest(range(n)) AS part FROM (SELECT *, (length(x) + 511) // 512 AS n FROM {side}_text)))",
        level(0, 1),
        level(1, 2),
    ]


ORACLE["file_blocks"] = with_(
    *_tree("a", "c_mktsegment"),
    *_tree("b", "CASE WHEN (c_custkey // 100) % 5 = 1 AND c_custkey % 100 = 50 THEN 'ALTERED' ELSE c_mktsegment END"),
    "dif AS (SELECT file, count(*) AS n_altered, min(part) AS first_altered FROM (SELECT file, part, a0.h AS ah, b0.h AS bh FROM a0 FULL JOIN b0 USING (file, part)) "
    "WHERE ah IS DISTINCT FROM bh GROUP BY file)",
) + (
    "SELECT file, a2.h AS recorded, b2.h AS recomputed, coalesce(n_altered, 0) AS n_altered, first_altered "
    "FROM a2 FULL JOIN b2 USING (file) LEFT JOIN dif USING (file)"
)

ORACLE["measured_stages"] = with_(
    LI,
    "runs AS (SELECT 'records' AS stage, count(*) AS rows FROM li UNION ALL SELECT 'evidence', count(*) FROM li "
    "UNION ALL SELECT 'scores', count(*) FROM li GROUP BY split)",
    "sizes AS (SELECT stage, rows, count(*) AS runs FROM runs GROUP BY ALL)",
) + (
    "SELECT stage, rows, runs, (sum(runs) OVER w)::BIGINT AS stage_runs, (sum(rows * runs) OVER w)::BIGINT AS stage_rows, "
    "true AS timed FROM sizes WINDOW w AS (PARTITION BY stage)"
)
