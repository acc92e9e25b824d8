"""Plain SQL building blocks for the checks: shared CTEs and least squares.

SQL has no multi-column regression; sequential orthogonalisation gives the same
residuals. Every column is projected out of all later ones, a column that is
already explained (relative squared norm <= 1e-18) is skipped, which leaves the
minimum-norm fit. Ridge is the same with sqrt(alpha) rows appended; unit probe
rows outside the training set read off the coefficients, and the sum of squared
orthonormal entries of a row is its hat value.
"""

from __future__ import annotations

from collections.abc import Sequence

P0, P1, TRAIN_END, VAL_END = "1996-01-01", "2000-12-31", "1999-12-31", "2000-06-30"
EXO = ["exo_sum", "exo_high", "exo_low", "exo_count"]
HARMONICS = [f"cal_{f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")]
BASELINE = ["cal_trend", *(f"cal_dow_{i}" for i in range(1, 7)), *HARMONICS]
CALENDAR = [*BASELINE, "cal_is_holiday"]


def calendar_exprs(d: str = "date", holiday: bool = True) -> dict[str, str]:
    out = {"cal_trend": f"CAST(date_diff('day', DATE '{P0}', {d}) AS DOUBLE)"}
    for i in range(1, 7):
        out[f"cal_dow_{i}"] = f"CAST(isodow({d}) = {i + 1} AS DOUBLE)"
    for k in (1, 2, 3):
        out[f"cal_sin_{k}"] = f"sin(2 * pi() * {k} * dayofyear({d}) / 365.25)"
        out[f"cal_cos_{k}"] = f"cos(2 * pi() * {k} * dayofyear({d}) / 365.25)"
    if holiday:
        out["cal_is_holiday"] = f"CAST({d} IN (SELECT date FROM hol) AS DOUBLE)"
    return out


def calendar_select(d: str = "date", holiday: bool = True) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in calendar_exprs(d, holiday).items())


def lag_select(key: str, y: str = "y") -> str:
    w = f"(PARTITION BY {key} ORDER BY date)"
    roll = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    parts = [f"lag({y}, {k}) OVER {w} AS lag_y_{k}" for k in (1, 7, 14)]
    parts.append(f"CASE WHEN count({y}) OVER {roll} = 7 THEN avg({y}) OVER {roll} END AS lag_roll_mean_7")
    return ", ".join(parts)


LAGS = ["lag_y_1", "lag_y_7", "lag_y_14", "lag_roll_mean_7"]

FIXED = [(1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)]
NTH = [(1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)]


def _holidays() -> str:
    years = "SELECT CAST(range AS INTEGER) AS y FROM range(1990, 2012)"
    parts = []
    for m, d, since in FIXED:
        h = f"make_date(y, {m}, {d})"
        parts.append(f"SELECT {h} AS date FROM yrs WHERE y >= {since}")
        parts.append(
            f"SELECT CAST(CASE isodow({h}) WHEN 6 THEN {h} - 1 WHEN 7 THEN {h} + 1 ELSE {h} END AS DATE) FROM yrs WHERE y >= {since}"
        )
    for m, wd, n in NTH:
        first = f"make_date(y, {m}, 1)"
        parts.append(f"SELECT CAST({first} + CAST(({wd} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER) AS DATE) FROM yrs")
    last = "make_date(y, 5, 31)"
    parts.append(f"SELECT CAST({last} - CAST(isodow({last}) - 1 AS INTEGER) AS DATE) FROM yrs")
    return f"SELECT DISTINCT date FROM (WITH yrs AS ({years}) {' UNION ALL '.join(parts)})"


def _tally(priority: str) -> str:
    return f"CAST(count(*) FILTER (WHERE o_orderpriority = '{priority}') AS DOUBLE)"


_FREE = f"BETWEEN DATE '{P0}' AND DATE '{P1}'"
_SLOT = (
    "CASE WHEN isodow(date) < 6 AND hour IN (7, 8, 9) THEN 'time_wdAM' "
    "WHEN isodow(date) >= 6 AND hour IN (11, 12, 13, 14, 15) THEN 'time_weMID' END"
)

# name -> (needed CTEs, body)
CTES: dict[str, tuple[list[str], str]] = {
    "hol": ([], _holidays()),
    "spine": ([], f"SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{P0}', DATE '{P1}', INTERVAL 1 DAY) t(d)"),
    "trips": (
        [],
        """SELECT CAST(l_shipdate AS DATE) AS date, (l_orderkey + l_linenumber * 5) % 24 AS hour,
        s_nationkey AS zone, c_nationkey AS origin, l_orderkey,
        CASE WHEN l_linestatus = 'O' THEN 'member' ELSE 'casual' END AS member_casual,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS start_station_id,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS end_station_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "ptrips": (["trips"], f"SELECT * FROM trips WHERE date {_FREE}"),
    "zcounts": (["ptrips"], "SELECT date, zone, CAST(count(*) AS DOUBLE) AS demand FROM ptrips GROUP BY date, zone"),
    "top": (
        ["zcounts"],
        f"""SELECT zone, sum(demand) AS total FROM zcounts WHERE date <= DATE '{TRAIN_END}' AND zone NOT IN (13, 18)
        GROUP BY zone ORDER BY total DESC, zone LIMIT 10""",
    ),
    "panel": (
        ["top", "spine", "zcounts"],
        """SELECT date, zone, coalesce(demand, 0.0) AS demand
        FROM (SELECT date, zone FROM spine, top) g LEFT JOIN zcounts USING (date, zone)""",
    ),
    "exo": (
        ["spine"],
        f"""SELECT date, exo_mean, exo_max, exo_min, coalesce(exo_sum, 0.0) AS exo_sum,
        coalesce(exo_high, 0.0) AS exo_high, coalesce(exo_low, 0.0) AS exo_low, coalesce(exo_count, 0.0) AS exo_count
        FROM spine LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) / count(*) AS exo_mean,
        max(o_totalprice) AS exo_max, min(o_totalprice) AS exo_min, {_tally('1-URGENT')} AS exo_sum,
        {_tally('2-HIGH')} AS exo_high, {_tally('5-LOW')} AS exo_low, CAST(count(*) AS DOUBLE) AS exo_count
        FROM orders GROUP BY 1) o USING (date)""",
    ),
    "permits_all": (
        [],
        """SELECT event_id, day, string_agg(CAST(nation AS VARCHAR), ',' ORDER BY nation) || ',' AS police_precinct
        FROM (SELECT DISTINCT l_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day, s_nationkey AS nation
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
        GROUP BY event_id, day""",
    ),
    "permits": (["permits_all"], f"SELECT * FROM permits_all WHERE day {_FREE}"),
    "pairs": (
        ["permits"],
        """SELECT DISTINCT event_id, day AS date, CAST(trim(tok) AS INTEGER) AS precinct
        FROM (SELECT event_id, day, unnest(string_split(police_precinct, ',')) AS tok FROM permits)
        WHERE regexp_full_match(trim(tok), '[0-9]+')""",
    ),
    "areas": (
        ["trips"],
        "SELECT zone AS precinct, origin AS LocationID, CAST(count(*) AS DOUBLE) AS area FROM trips GROUP BY 1, 2",
    ),
    "cw": (
        ["areas"],
        """SELECT precinct, LocationID, share / sum(share) OVER (PARTITION BY precinct) AS weight
        FROM (SELECT *, area / sum(area) OVER (PARTITION BY precinct) AS share FROM areas) WHERE share >= 0.03""",
    ),
    "zmass": (
        ["pairs", "cw"],
        """SELECT date, LocationID AS zone, sum(weight) AS event_count FROM pairs JOIN cw USING (precinct)
        GROUP BY 1, 2 HAVING sum(weight) > 0""",
    ),
    "city": (["permits"], "SELECT day AS date, count(DISTINCT event_id) AS event_count FROM permits GROUP BY day"),
    "merged": (
        ["panel", "exo", "city", "zmass"],
        """SELECT p.date, p.zone, p.demand, x.exo_sum, x.exo_high, x.exo_low, x.exo_count,
        CAST(coalesce(c.event_count, 0) AS BIGINT) AS event_count, coalesce(z.event_count, 0.0) AS event_count_zone,
        sum(coalesce(z.event_count, 0.0)) OVER (PARTITION BY p.date) AS event_count_manhattan
        FROM panel p LEFT JOIN exo x ON p.date = x.date LEFT JOIN city c ON p.date = c.date
        LEFT JOIN zmass z ON p.date = z.date AND p.zone = z.zone""",
    ),
    "feats": (
        ["merged", "hol"],
        "SELECT *, "
        + ", ".join(f"lag(demand, {k}) OVER (PARTITION BY zone ORDER BY date) AS demand_lag_{k}" for k in (1, 2, 3, 7, 14))
        + """, CASE WHEN count(demand) OVER r = 7 THEN avg(demand) OVER r END AS demand_rolling_mean_7,
        sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS dow_cos,
        sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
        CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(date IN (SELECT date FROM hol) AS INTEGER) AS is_holiday
        FROM merged WINDOW r AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    ),
    "wide": (
        ["spine", "ptrips"],
        """SELECT date, coalesce(member, 0) AS member, coalesce(casual, 0) AS casual, coalesce(member, 0) + coalesce(casual, 0) AS total
        FROM spine LEFT JOIN (SELECT date, count(*) FILTER (WHERE member_casual = 'member') AS member,
        count(*) FILTER (WHERE member_casual = 'casual') AS casual FROM ptrips GROUP BY date) t USING (date)""",
    ),
    "series": (
        ["wide"],
        " UNION ALL ".join(f"SELECT date, '{t}' AS target, CAST({t} AS DOUBLE) AS y FROM wide" for t in ("total", "member", "casual")),
    ),
    "seg": (
        ["ptrips"],
        f"""SELECT date, segment, count(*) AS n FROM (SELECT date, unnest(['all',
        CASE WHEN start_station_id = end_station_id THEN 'rt_round' ELSE 'rt_point' END,
        'user_' || member_casual, {_SLOT}]) AS segment FROM ptrips) WHERE segment IS NOT NULL GROUP BY 1, 2""",
    ),
    "ohours": (
        [],
        f"""SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey % 24 AS hour, sum(o_totalprice / 1000.0) AS ridership
        FROM orders WHERE CAST(o_orderdate AS DATE) {_FREE} GROUP BY 1, 2""",
    ),
    "oseg": (
        ["ohours"],
        f"""SELECT date, segment, CAST(round_even(round(sum(ridership), 6), 0) AS BIGINT) AS n FROM
        (SELECT date, ridership, unnest(['all', {_SLOT}]) AS segment FROM ohours) WHERE segment IS NOT NULL GROUP BY 1, 2""",
    ),
    "modes": (
        ["seg", "oseg"],
        "SELECT 'trips' AS mode, date, segment, n FROM seg UNION ALL SELECT 'orders' AS mode, date, segment, n FROM oseg",
    ),
}


def with_ctes(names: Sequence[str], body: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    """WITH clause holding the named CTEs, what they need, and ``extra`` ones after them."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, text = CTES[name]
            for need in needs:
                add(need)
            done[name] = text

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({t})" for n, t in [*done.items(), *extra]]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def r6_all(cols: Sequence[str]) -> str:
    return ", ".join(r6(c) for c in cols)


def orthogonalize(
    prefix: str, source: str, keys: Sequence[str], xs: Sequence[str], ys: Sequence[str], carry: Sequence[str] = (), hat: bool = False
) -> list[tuple[str, str]]:
    """CTEs that project ``xs`` one after the other out of ``ys``; the last is ``<prefix>_out``.

    ``source`` has the key, carry, x, y and boolean ``is_train`` columns.
    """
    k = ", ".join(keys)
    norms = ", ".join(f"sum({x} * {x}) FILTER (WHERE is_train) AS n_{x}" for x in xs)
    first = ", ".join([*keys, "is_train", *carry, *xs, *ys] + (["CAST(0 AS DOUBLE) AS hat"] if hat else []))
    out = [(f"{prefix}_n", f"SELECT {k}, {norms} FROM {source} GROUP BY {k}"), (f"{prefix}_0", f"SELECT {first} FROM {source}")]
    for i, q in enumerate(xs):
        rest = [*xs[i + 1 :], *ys]
        dots = ", ".join([f"sum({q} * {q}) AS dd", *(f"sum({q} * {c}) AS d_{c}" for c in rest)])
        out.append((f"{prefix}_d{i}", f"SELECT {k}, {dots} FROM {prefix}_{i} WHERE is_train GROUP BY {k}"))
        cols = [*keys, "is_train", *carry, *(f"{c} - q_ * d_{c} AS {c}" for c in rest)]
        if hat:
            cols.append(f"hat + q_ * {q} AS hat")
        inner = (
            f"SELECT s.*, {', '.join(f'd.d_{c}' for c in rest)}, "
            f"CASE WHEN d.dd > 1e-18 * n.n_{q} THEN s.{q} / d.dd ELSE 0.0 END AS q_ "
            f"FROM {prefix}_{i} s JOIN {prefix}_d{i} d USING ({k}) JOIN {prefix}_n n USING ({k})"
        )
        name = f"{prefix}_out" if i == len(xs) - 1 else f"{prefix}_{i + 1}"
        out.append((name, f"SELECT {', '.join(cols)} FROM ({inner})"))
    return out


def ridge(
    prefix: str,
    source: str,
    keys: Sequence[str],
    xs: Sequence[str],
    y: str,
    alphas: str,
    carry: Sequence[str] = ("date",),
    alpha_keys: Sequence[str] = (),
) -> list[tuple[str, str]]:
    """Ridge on standardised columns for every row of the ``alphas`` relation (a, alpha).

    The result ``<prefix>_out`` has (keys, a, is_train, carry, kind, probe, y, hat):
    kind 0 = data rows with ``y`` = y - fitted, kind 2 = probes with ``y`` = -coefficient.
    ``alpha_keys`` names key columns that ``alphas`` carries itself.
    """
    k = ", ".join(keys)
    stats = ", ".join(
        f"avg({x}) AS m_{x}, CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1.0 END AS s_{x}" for x in xs
    )
    z = ", ".join(f"(s.{x} - t.m_{x}) / t.s_{x} AS {x}" for x in xs)
    blank = ", ".join(f"NULL AS {c}" for c in carry)

    def unit(value: str) -> str:
        return ", ".join(f"CASE WHEN probe = {j} THEN {value} ELSE 0.0 END AS {x}" for j, x in enumerate(xs))

    join = f"JOIN {alphas} b USING ({', '.join(alpha_keys)})" if alpha_keys else f", {alphas} b"
    st = f"SELECT {k}, count(*) AS n, avg({y}) AS m_y_, {stats} FROM {source} WHERE is_train GROUP BY {k}"
    data = (
        f"SELECT {', '.join('s.' + c for c in keys)}, b.a, s.is_train, {', '.join('s.' + c for c in carry)}, 0 AS kind, -1 AS probe, "
        f"{z}, s.{y} - t.m_y_ AS {y} FROM {source} s JOIN {prefix}_st t USING ({k}) {join}"
    )
    aug = ", ".join(
        [*keys, "a", "is_train", blank, "kind", "probe", ", ".join(
            f"CASE WHEN probe = {j} THEN size ELSE 0.0 END AS {x}" for j, x in enumerate(xs)), f"0.0 AS {y}"]
    )
    extra = (
        f"SELECT {aug} FROM (SELECT t.*, b.a, b.alpha, p.probe, r.kind, r.kind = 1 AS is_train, "
        f"CASE WHEN r.kind = 1 THEN sqrt(b.alpha) ELSE 1.0 END AS size FROM {prefix}_st t {join}, "
        f"(SELECT CAST(range AS INTEGER) AS probe FROM range({len(xs)})) p, (VALUES (1), (2)) r(kind))"
    )
    all_keys = [*keys, "a"]
    return [
        (f"{prefix}_st", st),
        (f"{prefix}_z", f"{data} UNION ALL {extra}"),
        *orthogonalize(prefix, f"{prefix}_z", all_keys, xs, [y], [*carry, "kind", "probe"], hat=True),
    ]


def ridge_search(
    prefix: str, source: str, conditions: dict[str, Sequence[str]], y: str, draws: str, folds: int, row: Sequence[str]
) -> list[tuple[str, str]]:
    """Searched ridge of pooled rows by the normal equations of every (condition, fold, draw), solved by elimination.

    ``source`` has the ``row`` key, date, y, all columns and ``block`` (null outside train days). Fold
    ``folds`` stands for the refit on all train rows. The result ``<prefix>_pred`` holds (condition,
    row, pred) of the rows outside train at the draw with the lowest mean fold error.
    """
    xs = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    at = {c: i for i, c in enumerate(xs)}
    sd = {x: f"CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1.0 END" for x in xs}
    pairs = [(a, b) for a in xs for b in [*xs[at[a] :], y]]
    cells = ", ".join(
        "{" + f"'i': {at[a]}, 'j': {at.get(b, len(xs))}, 'v': covar_pop({a}, {b}) * count(*) / ({sd[a]}{f' * {sd[b]}' if b in sd else ''})" + "}" for a, b in pairs
    )
    member = ", ".join(f"('{c}', {at[x]})" for c, cols in conditions.items() for x in cols)
    keys = "condition, fold, a"
    out = [
        (f"{prefix}_f", f"SELECT CAST(range AS INTEGER) AS fold FROM range({folds + 1})"),
        (f"{prefix}_t", f"SELECT f.fold, s.* FROM {source} s JOIN {prefix}_f f ON s.block <= f.fold"),
        (f"{prefix}_s", f"SELECT fold, avg({y}) AS m_y, [{', '.join(f'avg({x})' for x in xs)}] AS m, [{', '.join(sd[x] for x in xs)}] AS s FROM {prefix}_t GROUP BY fold"),
        (f"{prefix}_c", f"SELECT fold, unnest(c) AS c FROM (SELECT fold, [{cells}] AS c FROM {prefix}_t GROUP BY fold)"),
        (f"{prefix}_g", f"SELECT fold, c.i AS i, c.j AS j, c.v AS v FROM {prefix}_c UNION ALL SELECT fold, c.j, c.i, c.v FROM {prefix}_c WHERE c.i < c.j AND c.j < {len(xs)}"),
        (f"{prefix}_m", f"SELECT * FROM (VALUES {member}) v(condition, i)"),
        (
            f"{prefix}_0",
            f"""SELECT m.condition, g.fold, d.a, g.i, g.j, g.v + CASE WHEN g.i = g.j THEN d.alpha ELSE 0.0 END AS v FROM {prefix}_g g JOIN {prefix}_m m USING (i)
            JOIN {draws} d ON true WHERE g.j = {len(xs)} OR EXISTS (SELECT 1 FROM {prefix}_m n WHERE n.condition = m.condition AND n.i = g.j)""",
        ),
    ]
    for k in range(len(xs)):  # what a column explains leaves all others; its own row is divided by its pivot
        top = f"SELECT {keys}, j, v / max(CASE WHEN j = {k} THEN v END) OVER (PARTITION BY {keys}) AS v FROM {prefix}_{k} WHERE i = {k}"
        side = f"SELECT {keys}, i, v FROM {prefix}_{k} WHERE j = {k} AND i <> {k}"
        out.append(
            (
                f"{prefix}_{k + 1}",
                f"""SELECT {keys}, x.i, x.j, CASE WHEN x.i = {k} THEN coalesce(t.v, x.v) ELSE x.v - coalesce(c.v * t.v, 0.0) END AS v FROM {prefix}_{k} x
                LEFT JOIN ({top}) t USING ({keys}, j) LEFT JOIN ({side}) c USING ({keys}, i) WHERE x.j > {k}""",
            )
        )
    n = len(xs)
    out += [
        (f"{prefix}_b", f"SELECT {keys}, list(coalesce(v, 0.0) ORDER BY i) AS b FROM (SELECT {keys}, i, v FROM {prefix}_{n} WHERE j = {n}) RIGHT JOIN (SELECT DISTINCT {keys}, r.range AS i FROM {prefix}_0, range({n}) r) USING ({keys}, i) GROUP BY {keys}"),
        (
            f"{prefix}_w",
            f"""SELECT {keys}, b.b, s.m_y, s.m, s.s FROM {prefix}_b b JOIN {prefix}_s s USING (fold)""",
        ),
        (f"{prefix}_z", f"SELECT {', '.join(row)}, block, {y}, [{', '.join(f'CAST({x} AS DOUBLE)' for x in xs)}] AS x FROM {source}"),
    ]
    out += [
        # In raw terms a prediction is an intercept and one inner product.
        (
            f"{prefix}_r",
            f"""SELECT {keys}, list_transform(list_zip(b, s), lambda q: q[1] / q[2]) AS beta,
            m_y - list_sum(list_transform(list_zip(b, m, s), lambda q: q[1] * q[2] / q[3])) AS level FROM {prefix}_w""",
        ),
        (
            f"{prefix}_e",
            f"SELECT r.condition, r.fold, r.a, avg(abs({y} - level - list_inner_product(x, beta))) AS mae FROM {prefix}_z z JOIN {prefix}_r r ON z.block = r.fold + 1 GROUP BY 1, 2, 3",
        ),
        (f"{prefix}_p", f"SELECT condition, arg_min(a, (cv, a)) AS a FROM (SELECT condition, a, avg(mae) AS cv FROM {prefix}_e GROUP BY 1, 2) GROUP BY 1"),
        (
            f"{prefix}_pred",
            f"""SELECT r.condition, {', '.join('z.' + c for c in row)}, level + list_inner_product(x, beta) AS pred FROM {prefix}_r r JOIN {prefix}_p p USING (condition, a)
            JOIN {prefix}_z z ON z.block IS NULL WHERE r.fold = {folds}""",
        ),
    ]
    return out


ALPHA_ROWS = "SELECT CAST(range AS INTEGER) AS a, pow(10, -2 + 6.0 * range / 29) AS alpha FROM range(30)"


def hash_uniform(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656.0)"


def corr_expr(x: str, y: str, where: str = "") -> str:
    """Pearson correlation, null on a constant column."""
    f = f" FILTER (WHERE {where})" if where else ""
    return (
        f"CASE WHEN stddev_pop({x}){f} > 0 AND stddev_pop({y}){f} > 0 "
        f"THEN covar_pop({x}, {y}){f} / (stddev_pop({x}){f} * stddev_pop({y}){f}) END"
    )


def residual_ctes(
    source: str, keys: Sequence[str], y: str = "y", exo: Sequence[str] = EXO, train: str = f"date <= DATE '{TRAIN_END}'"
) -> list[tuple[str, str]]:
    """From (keys, date, y, exo) to ``res``: keys, date, y, resid, anom_*, calendar columns.

    ``train`` may name columns of ``source``, such as each row's own train end.
    """
    k = ", ".join(keys)
    cal = calendar_select(holiday=False)
    design = f"SELECT {k}, date, {y}, {', '.join(exo)}, {cal}, 1.0 AS one, {train} AS is_train FROM {source}"
    out = [("design", design)]
    out += orthogonalize("gy", "design", keys, ["one", *BASELINE], [y], ["date"])
    out += orthogonalize("gx", "design", keys, ["one", *HARMONICS], exo, ["date"])
    anoms = ", ".join(f"gx_out.{v} AS anom_{v}" for v in exo)
    cols = ", ".join(f"design.{c}" for c in BASELINE)
    out.append(
        (
            "res",
            f"SELECT {', '.join('design.' + c for c in keys)}, design.date, design.is_train, design.{y}, gy_out.{y} AS resid, {anoms}, {cols} "
            f"FROM design JOIN gy_out USING ({k}, date) JOIN gx_out USING ({k}, date)",
        )
    )
    return out
