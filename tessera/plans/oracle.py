"""DuckDB SQL of the engine's steps, from which the oracles are put together. Independent of the engine's code."""

from __future__ import annotations

COS = "(SELECT vec_id AS row_id, list_transform(embedding, lambda x: (x * (1::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT)::FLOAT) AS vec, label FROM embeddings)"
SCALED = "(SELECT vec_id AS row_id, list_transform(embedding, lambda x: (x * (1 + label)::FLOAT)::FLOAT) AS vec, label FROM embeddings)"
BANKS = {"cos": COS, "dot": SCALED, "l2": SCALED}
CHANNELS = ((0, 16), (16, 16), (32, 16), (48, 16))
TINY = "1.1754943508222875e-38::DOUBLE"


def part(v: str, offset: int, length: int) -> str:
    return f"list_slice({v}, {offset + 1}, {offset + length})"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def floor(s: str) -> str:
    return f"(CASE WHEN abs({s}) < {TINY} THEN 0::FLOAT ELSE ({s})::FLOAT END)"


def max_abs(v: str) -> str:
    return f"list_max(list_transform({v}, lambda x: abs(x)))"


def int8(bank: str) -> str:
    return (
        "(SELECT row_id, label, list_transform(vec, lambda x: round_even(x * inv, 0)::INTEGER) AS q8, (m / 127::FLOAT)::FLOAT AS scale FROM "
        f"(SELECT *, (127::FLOAT / m)::FLOAT AS inv FROM (SELECT *, {max_abs('vec')} AS m FROM {bank})))"
    )


def lanes(q8: str = "q8", scale: str = "scale") -> str:
    return f"list_transform({q8}, lambda x: (x::FLOAT * {scale})::FLOAT)"


def inverse_norm(v: str) -> str:
    return f"(1::DOUBLE / sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])))::FLOAT"


def payload(queries: str) -> str:
    """(query_id, q8, q_scale, q_sq) of (query_id, q); a zero vector gives zeros."""
    return (
        "(SELECT query_id, q8, m / 127::DOUBLE AS q_scale, list_inner_product(q8::DOUBLE[], q8::DOUBLE[])::BIGINT AS q_sq FROM "
        "(SELECT query_id, m, list_transform(q, lambda x: CASE WHEN m = 0 THEN 0 ELSE round_even(x::DOUBLE * (127::DOUBLE / m), 0)::INTEGER END) AS q8 FROM "
        f"(SELECT query_id, q, {max_abs('q::DOUBLE[]')} AS m FROM {queries})))"
    )


def stored_payload(bank8: str, offset: int = 0, length: int = 64) -> str:
    """Payloads of a bank's rows on a range, as stored."""
    lanes = part("q8", offset, length)
    return f"(SELECT row_id AS query_id, {lanes} AS q8, scale::DOUBLE AS q_scale, list_inner_product({lanes}::DOUBLE[], {lanes}::DOUBLE[])::BIGINT AS q_sq FROM {bank8})"


def payload_part(payloads: str, offset: int, length: int) -> str:
    lanes = part("q8", offset, length)
    return f"(SELECT query_id, {lanes} AS q8, q_scale, list_inner_product({lanes}::DOUBLE[], {lanes}::DOUBLE[])::BIGINT AS q_sq FROM {payloads})"


def xd_dot(cross: str, rs: str, qs: str) -> str:
    return f"({cross} * ({rs}::DOUBLE * {qs}))"


def xd_l2(cross: str, rsq: str, qsq: str, rs: str, qs: str) -> str:
    return f"((({qs} * {qs}) * {qsq}::DOUBLE + ({rs}::DOUBLE * {rs}::DOUBLE) * {rsq}::DOUBLE) - (({rs}::DOUBLE * {qs}) * {cross}) * 2::DOUBLE)"


def xd_pair(metric: str, a: str = "a", b: str = "b", zero: str = "0") -> str:
    """Distance of payload rows a and b (q8, q_scale, q_sq)."""
    cross = dot(f"{a}.q8", f"{b}.q8")
    if metric == "dot":
        return xd_dot(cross, f"{a}.q_scale", f"{b}.q_scale")
    if metric == "l2":
        return xd_l2(cross, f"{b}.q_sq", f"{a}.q_sq", f"{b}.q_scale", f"{a}.q_scale")
    energy = f"({a}.q_sq::DOUBLE * {b}.q_sq::DOUBLE)"
    return f"(CASE WHEN {energy} = 0 THEN {zero} ELSE 1::DOUBLE - {cross} / sqrt({energy}) END)"


def rows_as_queries(bank8: str) -> str:
    return f"(SELECT row_id AS query_id, {lanes()} AS q, label FROM {bank8})"


def query_set(bank: str, where: str = "row_id < 20") -> str:
    return f"(SELECT row_id AS query_id, vec AS q FROM {bank} WHERE {where})"


def scored(bank: str, queries: str, score: str, where: str = "query_id <> row_id") -> str:
    """(query_id, row_id, label, score); b is the bank, q the queries."""
    return f"(SELECT q.query_id, b.row_id, b.label, {score} AS score FROM {bank} b, {queries} q WHERE {where})"


def top(pairs: str, higher: bool, k: int = 10) -> str:
    order = "DESC" if higher else "ASC"
    return f"SELECT query_id, rank, row_id, score FROM (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, row_id)::INTEGER AS rank FROM {pairs}) WHERE rank <= {k}"


def float_score(metric: str, q: str = "q.q", v: str = "b.vec") -> str:
    return l2(q, v) if metric == "l2" else dot(q, v)


def xd_score(metric: str) -> str:
    cross = dot("q.q8", "b.q8")
    return floor(xd_l2(cross, dot("b.q8", "b.q8"), "q.q_sq", "b.scale", "q.q_scale") if metric == "l2" else xd_dot(cross, "b.scale", "q.q_scale"))


def ordered_mean(value: str, order: str) -> str:
    return f"(list_sum(list({value}::DOUBLE ORDER BY {order})) / count(*))"


def half_even_quotient(n: str, d: str) -> str:
    q, r2 = f"(abs({n}) // {d})", f"(2 * (abs({n}) % {d}))"
    return f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ({q} + CASE WHEN {r2} > {d} OR ({r2} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END))"


def pooled(bank8: str, rows: str, offset: int = 0, length: int = 64) -> str:
    """Payloads of sets; ``rows`` has query_id, row_id and weight."""
    return (
        "(SELECT query_id, q8, q_scale, list_inner_product(q8::DOUBLE[], q8::DOUBLE[])::BIGINT AS q_sq FROM (SELECT query_id, "
        f"list_transform(acc, lambda x: {half_even_quotient('(x * 127)', 'most')}::INTEGER) AS q8, (most::DOUBLE / (weights::DOUBLE * 127::DOUBLE)) * top * power(2::DOUBLE, -24) AS q_scale FROM "
        f"(SELECT *, greatest(1, {max_abs('acc')})::BIGINT AS most FROM (SELECT query_id, list(x ORDER BY pos) AS acc, any_value(weights) AS weights, any_value(top) AS top FROM "
        "(SELECT query_id, pos, sum(lane * m)::BIGINT AS x, any_value(weights) AS weights, any_value(top) AS top FROM "
        "(SELECT query_id, weights, top, (weight * round_even(scale::DOUBLE / top * 16777216::DOUBLE, 0))::BIGINT AS m, unnest(lanes)::BIGINT AS lane, generate_subscripts(lanes, 1) AS pos FROM "
        f"(SELECT r.query_id, r.weight, b.scale, {part('b.q8', offset, length)} AS lanes, max(b.scale::DOUBLE) OVER (PARTITION BY r.query_id) AS top, sum(r.weight) OVER (PARTITION BY r.query_id)::BIGINT AS weights FROM {rows} r JOIN {bank8} b USING (row_id))) "
        "GROUP BY query_id, pos) GROUP BY query_id))))"
    )


def components(bank: str, dims: int, count: int, iterations: int) -> str:
    """CTEs (to follow WITH RECURSIVE): mean (m), and found1 to found<count> (v), by power iteration on the covariance."""
    lanes = f"lanes AS MATERIALIZED (SELECT row_id, generate_subscripts(vec, 1) AS pos, unnest(vec)::DOUBLE AS x FROM {bank})"
    means = "means AS MATERIALIZED (SELECT pos, avg(x) AS m FROM lanes GROUP BY pos), mean AS MATERIALIZED (SELECT list(m ORDER BY pos) AS m FROM means)"
    entry = "SELECT a.pos AS i, b.pos AS j, avg(a.x * b.x) - any_value(p.m) * any_value(q.m) AS c FROM lanes a JOIN lanes b USING (row_id) JOIN means p ON p.pos = a.pos JOIN means q ON q.pos = b.pos GROUP BY a.pos, b.pos"
    cov = f"cov AS MATERIALIZED (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS r FROM ({entry}) GROUP BY i))"
    parts = [lanes, means, cov]
    for k in range(1, count + 1):
        before = range(1, k)
        sides = "".join(f", found{f}" for f in before)
        start = f"list_transform(range({dims}), lambda i: (i = {k - 1})::INTEGER::DOUBLE)"
        times = f"SELECT it, list_transform(c, lambda r: list_inner_product(r, step{k}.v)) AS w FROM step{k}, cov WHERE it < {iterations}"
        dots = "".join(f", list_inner_product(w, found{f}.v) AS d{f}, found{f}.v AS f{f}" for f in before)
        left = "list_transform(range(1, %d), lambda i: w[i]%s)" % (dims + 1, "".join(f" - d{f} * f{f}[i]" for f in before))
        unit = "list_transform(u, lambda x: x / sqrt(list_inner_product(u, u)))"
        step = f"SELECT it + 1, {unit} FROM (SELECT it, {left} AS u FROM (SELECT it, w{dots} FROM ({times}){sides}))"
        parts += [f"step{k} AS (SELECT 0 AS it, {start} AS v UNION ALL {step})", f"found{k} AS MATERIALIZED (SELECT v FROM step{k} WHERE it = {iterations})"]
    return ", ".join(parts)


def exploded(rows: str, key: str, value: str) -> str:
    """(key, pos from 0, value) of list columns."""
    return f"SELECT {key}, (generate_subscripts({value}, 1) - 1)::INTEGER AS pos, unnest({value}) AS value FROM {rows}"
