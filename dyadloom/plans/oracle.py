"""DuckDB SQL for the registered queries, over one chain of common expressions."""

from __future__ import annotations

from ..functions.blocks import STEP, TIMES
from ..sources.adapters import ANNOTATIONS, COFACTOR, COMPLEX, LR, LR_COLUMNS

#: As the queries have them: the operators' defaults.
NBOOT = 100
_TOP = "18446744073709551616::UHUGEINT"


def _values(name: str, columns, rows) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v + "'"
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def _r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE AS {name or x}"


def _hill(x: str) -> str:
    return f"(({x}) / (0.5::DOUBLE + ({x})))"


def _avg(name: str, cells: str, value: str) -> str:
    return f"{name} AS (SELECT gene, grp, {value} AS value FROM (SELECT g.gene, c.cell, c.grp, coalesce(e.value, 0) AS v FROM {cells} c CROSS JOIN genes g LEFT JOIN expr e USING (cell, gene)) GROUP BY gene, grp)"


_TRI = "(quantile_cont(v, 0.25) + 2 * quantile_cont(v, 0.5) + quantile_cont(v, 0.75)) / 4"


def _cofactor(name: str, role: str, means: str, factor: str, by: str) -> str:
    return f"{name} AS (SELECT l.lr_ix, {by}, product({factor}) AS value FROM lr l JOIN cofactor c ON c.name = l.{role} AND c.member <> '' JOIN {means} m ON m.gene = c.member WHERE l.{role} <> '' GROUP BY l.lr_ix, {by})"


def _tensor(p: str, means: str, by: tuple[str, ...] = ("grp",), f: str = "1.0::DOUBLE") -> list[str]:
    """(lr_ix, more, src, tgt, prob) as ``p``prob from a table of means."""
    b, more = ", ".join(by), [x for x in by if x != "grp"]
    out = []
    for side in ("ligand", "receptor"):
        out.append(
            f"{p}{side} AS (SELECT lr_ix, {b}, CASE WHEN count(*) = 1 THEN max(value) WHEN min(value) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN value > 0 THEN value END))) END AS value "
            f"FROM (SELECT l.lr_ix, coalesce(c.member, l.{side}) AS gene FROM lr l LEFT JOIN (SELECT * FROM complex WHERE member <> '') c ON c.name = l.{side}) x JOIN {means} USING (gene) GROUP BY lr_ix, {b})"
        )
    for role, factor in (("co_a", "1 + value"), ("co_i", "1 + value"), ("agonist", "1 + " + _hill("value")), ("antagonist", "1 - " + _hill("value"))):
        out.append(_cofactor(p + role, role, means, factor, b))
    left = " ".join(f"LEFT JOIN {p}{r} {r} USING (lr_ix, {b})" for r in ("co_a", "co_i", "agonist", "antagonist"))
    out.append(
        f"{p}lrv AS (SELECT lr_ix, {b}, l.value AS l, r.value * coalesce(co_a.value, 1) / coalesce(co_i.value, 1) AS r, coalesce(agonist.value, 1) AS ag, coalesce(antagonist.value, 1) AS an, {f} AS f "
        f"FROM {p}ligand l JOIN {p}receptor r USING (lr_ix, {b}) {left})"
    )
    same = "".join(f" AND a.{x} = b.{x}" for x in more)
    cols = "".join(f"a.{x}, " for x in more)
    prob = f"{_hill('a.l * b.r')} * (a.ag * b.ag) * (a.an * b.an) * (a.f * b.f)"
    out.append(f"{p}prob AS (SELECT a.lr_ix, {cols}a.grp AS src, b.grp AS tgt, {prob} AS prob FROM {p}lrv a JOIN {p}lrv b ON a.lr_ix = b.lr_ix{same})")
    return out


def _base() -> str:
    ctes = [
        _values("lr", LR_COLUMNS, LR),
        _values("complex", ("name", "pos", "member"), COMPLEX),
        _values("cofactor", ("name", "pos", "member"), COFACTOR),
        "raw AS (SELECT o_custkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
        "cells AS (SELECT c_custkey AS cell, c_mktsegment AS grp, (c_custkey % 2)::INT AS sample FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))",
        "norm AS (SELECT cell, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell) * 10000.0::DOUBLE) AS value FROM raw)",
        "expr AS MATERIALIZED (SELECT cell, gene, value / (SELECT max(value) FROM norm) AS value FROM norm)",
        "genes AS (SELECT DISTINCT gene FROM expr)",
        "dense AS (SELECT g.gene, c.cell, c.grp, c.sample, coalesce(e.value, 0) AS v FROM cells c CROSS JOIN genes g LEFT JOIN expr e USING (cell, gene))",
        _avg("avg_tri", "cells", _TRI),
        *_tensor("o_", "avg_tri"),
        # labels dealt by a hash of cell and replicate, as functions.blocks has it; the groups, in order, take as many cells as they have
        "lab AS (SELECT grp, row_number() OVER (ORDER BY grp, cell) AS k FROM cells)",
        f"seed AS (SELECT b, cell, ((('0x' || substr(md5(cell::VARCHAR), 1, 15))::BIGINT::UHUGEINT + b::UHUGEINT * {STEP}::UHUGEINT) % {_TOP})::UBIGINT AS h FROM cells, (SELECT unnest(range(1, {NBOOT + 1})) AS b))",
        f"mix AS (SELECT b, cell, ((xor(h, h >> 32)::UHUGEINT * {TIMES}::UHUGEINT) % {_TOP})::UBIGINT AS h FROM seed)",
        f"mixed AS (SELECT b, cell, ((xor(h, h >> 32)::UHUGEINT * {TIMES}::UHUGEINT) % {_TOP})::UBIGINT AS h FROM mix)",
        "deal AS (SELECT b, cell, row_number() OVER (PARTITION BY b ORDER BY xor(h, h >> 32)) AS k FROM mixed)",
        "perm AS (SELECT b, cell, grp FROM deal JOIN lab USING (k))",
        f"avg_b AS (SELECT gene, b, grp, {_TRI} AS value FROM (SELECT p.b, p.grp, g.gene, coalesce(e.value, 0) AS v FROM perm p CROSS JOIN genes g LEFT JOIN expr e USING (cell, gene)) GROUP BY gene, b, grp)",
        *_tensor("b_", "avg_b", ("b", "grp")),
        "above AS (SELECT lr_ix, src, tgt, sum((x.prob > o.prob * (1 + 1e-12::DOUBLE))::INT) AS n FROM b_prob x JOIN o_prob o USING (lr_ix, src, tgt) GROUP BY 1, 2, 3)",
        f"seen AS MATERIALIZED (SELECT lr_ix, src, tgt, prob, CASE WHEN prob = 0 THEN 1 ELSE coalesce(n, 0) / {NBOOT} END::DOUBLE AS pval FROM o_prob LEFT JOIN above USING (lr_ix, src, tgt))",
        "kept AS (SELECT s.*, l.* EXCLUDE (lr_ix) FROM seen s LEFT JOIN lr l USING (lr_ix) WHERE pval < 0.05 AND prob > 0)",
        "psum AS (SELECT pathway_name, src, tgt, sum(CASE WHEN pval > 0.05 THEN 0 ELSE prob END) AS prob, min(lr_ix) AS first_ix FROM seen JOIN lr USING (lr_ix) GROUP BY 1, 2, 3)",
        "ptot AS (SELECT pathway_name, row_number() OVER (ORDER BY round(sum(prob), 9) DESC, min(first_ix))::INT AS pathway_ix FROM psum GROUP BY 1 HAVING sum(prob) > 0)",
        "netp AS (SELECT pathway_ix, pathway_name, src, tgt, prob FROM psum JOIN ptot USING (pathway_name))",
        "agg AS (SELECT src, tgt, count(*) FILTER (prob > 0 AND pval < 0.05) AS count, sum(CASE WHEN pval >= 0.05 THEN 0 ELSE prob END) AS weight FROM seen GROUP BY 1, 2)",
        _avg("avg_s0", "(SELECT * FROM cells WHERE sample = 0)", _TRI),
        _avg("avg_s1", "(SELECT * FROM cells WHERE sample = 1)", _TRI),
        *_tensor("s0_", "avg_s0"),
        *_tensor("s1_", "avg_s1"),
        "datasets AS (SELECT 0 AS dataset, * FROM s0_prob UNION ALL SELECT 1, * FROM s1_prob)",
        "sums AS (SELECT gene, grp, count(*) FILTER (v > 0) AS k, count(*) AS n, sum(exp(v) - 1) AS s FROM dense GROUP BY 1, 2)",
        "shares AS (SELECT gene, grp, round(k / n, 3) AS pct_1, round((sum(k) OVER w - k) / (sum(n) OVER w - n), 3) AS pct_2, ln(s / n + 1) - ln((sum(s) OVER w - s) / (sum(n) OVER w - n) + 1) AS logfc FROM sums WINDOW w AS (PARTITION BY gene))",
        "stats AS (SELECT gene AS name, grp, logfc, pct_1, pct_2 FROM shares UNION ALL SELECT name, grp, avg(logfc), avg(pct_1), avg(pct_2) FROM shares JOIN complex ON member = gene GROUP BY 1, 2)",
        "mapped AS (SELECT k.*, a.logfc AS ligand_logfc, a.pct_1 AS ligand_pct_1, a.pct_2 AS ligand_pct_2, b.logfc AS receptor_logfc, b.pct_1 AS receptor_pct_1, b.pct_2 AS receptor_pct_2 "
        "FROM kept k LEFT JOIN stats a ON a.name = k.ligand AND a.grp = k.src LEFT JOIN stats b ON b.name = k.receptor AND b.grp = k.tgt)",
        "place AS (SELECT vec_id AS cell, label AS grp, (vec_id % 2)::INT AS sample, round(embedding[1]::DOUBLE * 1000, 3) AS x, round(embedding[2]::DOUBLE * 1000, 3) AS y FROM embeddings)",
        "apart AS (SELECT a.sample, a.cell AS i, b.cell AS j, a.grp AS a, b.grp AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM place a JOIN place b ON a.sample = b.sample)",
        "near AS (SELECT sample, i AS node, j AS neighbour, row_number() OVER (PARTITION BY sample, i ORDER BY d, j)::INT AS rnk, d FROM apart WHERE i <> j)",
        "degree AS (SELECT pathway_name, grp, count(o) AS outdeg_unweighted, count(i) AS indeg_unweighted, coalesce(sum(o), 0) AS outdeg, coalesce(sum(i), 0) AS indeg "
        "FROM (SELECT pathway_name, src AS grp, prob AS o, NULL::DOUBLE AS i FROM netp WHERE prob > 0 UNION ALL SELECT pathway_name, tgt, NULL, prob FROM netp WHERE prob > 0) GROUP BY 1, 2)",
    ]
    return "WITH " + ",\n".join(ctes)


def _similar(live: str) -> list[str]:
    """Shared pairs, and shares of common neighbours among rows of that matrix."""
    return [
        f"live AS ({live})",
        "sz AS (SELECT name, count(*) AS n FROM live GROUP BY 1)",
        "kk AS (SELECT (ceil(sqrt(count(*))) + (count(*) > 25)::INT)::BIGINT AS k FROM sz)",
        "jc AS (SELECT x.name AS a, y.name AS b, count(*) AS c FROM live x JOIN live y USING (src, tgt) GROUP BY 1, 2)",
        "sm AS (SELECT x.name AS a, y.name AS b, CASE WHEN x.name = y.name THEN 1 ELSE coalesce(c / (x.n + y.n - c), 0) END::DOUBLE AS v FROM sz x CROSS JOIN sz y LEFT JOIN jc ON a = x.name AND b = y.name)",
        "di AS (SELECT l.a AS a, r.a AS b, round(sum(pow(l.v - r.v, 2)), 9) AS d FROM sm l JOIN sm r ON l.b = r.b WHERE l.a <> r.a GROUP BY 1, 2)",
        "ne AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM di) WHERE rn < (SELECT k FROM kk) UNION ALL SELECT name, name FROM sz)",
        "ov AS (SELECT x.a AS a, y.a AS b, count(*) / (2 * (SELECT k FROM kk) - count(*)) AS w FROM ne x JOIN ne y ON x.b = y.b GROUP BY 1, 2)",
    ]


_SMOOTHED = "SELECT a, b, round(v * w, 6) + 0.0::DOUBLE AS value FROM (SELECT a, b, v, CASE WHEN a = b THEN 1 WHEN w < 1 / 15 THEN 0 ELSE w END AS w FROM sm JOIN ov USING (a, b)) WHERE v * w > 0"


def _region(p: str, apart: str, reach: int) -> list[str]:
    """Trimmed distances of groups from (sample, i, j, a, b, d), as ``p``rb (a, b, d, adj)."""
    return [
        f"{p}nn AS (SELECT sample, i, a, b, min(d) AS d, arg_min(j, struct_pack(d := d, j := j)) AS nn FROM {apart} GROUP BY 1, 2, 3, 4)",
        f"{p}ro AS (SELECT *, row_number() OVER (PARTITION BY sample, a, b ORDER BY d, i) AS rn, count(*) OVER (PARTITION BY sample, a, b) AS n FROM {p}nn)",
        f"{p}rg AS (SELECT sample, a, b, avg(CASE WHEN rn > floor(n * 0.1::DOUBLE) AND rn <= n - floor(n * 0.1::DOUBLE) THEN d END) AS d, (count(DISTINCT CASE WHEN d - {reach} < 0 THEN nn END) >= 3)::INT AS adj FROM {p}ro GROUP BY 1, 2, 3)",
        f"{p}rb AS (SELECT a, b, avg(d) AS d, max(adj) AS adj FROM {p}rg GROUP BY 1, 2)",
    ]


def _flow(table: str, extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return (
        f"t AS (SELECT pathway_name{more}, sum(prob) AS total FROM {table} GROUP BY ALL HAVING sum(prob) > 0), "
        f"f AS (SELECT *, CASE WHEN round(total, 9) < 1 THEN -1 / ln(total) END AS flow, round(total, 9) >= 1 AS flagged FROM t), "
        f"g AS (SELECT *, row_number() OVER (PARTITION BY flagged ORDER BY round(total, 9), pathway_name{more}) - 1 AS rn, count(*) OVER (PARTITION BY flagged) AS n, coalesce(max(flow) OVER (), 1) AS top FROM f), "
        f"flow AS (SELECT pathway_name{more}, total, coalesce(flow, top * (1.1::DOUBLE + 0.4::DOUBLE * CASE WHEN n > 1 THEN rn / (n - 1) ELSE 0 END)) AS flow FROM g)"
    )


def queries() -> dict[str, str]:
    kept_net = "round(prob, 6) + 0.0::DOUBLE AS prob"
    group_mean = lambda v: f"SELECT gene, grp, {_r(v, 'value')} FROM dense GROUP BY gene, grp"
    truncated = (
        "SELECT gene, grp, " + _r("sum(CASE WHEN rn > floor(n * 0.1::DOUBLE) AND rn <= n - floor(n * 0.1::DOUBLE) THEN v ELSE 0 END) / (max(n) - 2 * floor(max(n) * 0.1::DOUBLE))", "value")
        + " FROM (SELECT *, row_number() OVER (PARTITION BY gene, grp ORDER BY v) AS rn, count(*) OVER (PARTITION BY gene, grp) AS n FROM dense) GROUP BY gene, grp"
    )
    levels = ", ".join(f"'{a}'" for a in ANNOTATIONS)
    found = (
        "SELECT lr_ix, side FROM (SELECT lr_ix, 0 AS side, ligand AS name FROM lr UNION ALL SELECT lr_ix, 1, receptor FROM lr) "
        "LEFT JOIN (SELECT * FROM complex WHERE member <> '') USING (name) WHERE coalesce(member, name) IN ('Brand#1', 'Brand#14')"
    )
    thresholded = "CASE WHEN count(*) FILTER (v <> 0) / count(*) < 0.8::DOUBLE THEN 0 ELSE sum(v) / count(*) END"
    support = [
        f"avg_p AS (SELECT gene, sample, grp, {thresholded} AS value FROM dense GROUP BY 1, 2, 3)",
        *_tensor("p_", "avg_p", ("sample", "grp")),
        "support AS (SELECT lr_ix, src, tgt, count(*) AS n FROM p_prob WHERE prob > 0 GROUP BY 1, 2, 3)",
    ]
    pop = [
        "frac AS (SELECT grp, count(*) / (SELECT count(*) FROM cells) AS f FROM cells GROUP BY grp)",
        "pp AS (SELECT o.lr_ix, o.src, o.tgt, o.prob * (a.f * b.f) AS prob FROM o_prob o JOIN frac a ON a.grp = o.src JOIN frac b ON b.grp = o.tgt)",
    ]
    wil = [
        "rk AS (SELECT gene, grp, v, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS r FROM dense)",
        "tie AS (SELECT gene, sum(t * t * t - t) AS t, sum(t) AS n FROM (SELECT gene, v, count(*)::DOUBLE AS t FROM dense GROUP BY 1, 2) GROUP BY 1)",
        "ws AS (SELECT gene, grp, count(*) AS n1, sum(r) - count(*) * (count(*) + 1) / 2 AS w FROM rk GROUP BY 1, 2)",
        "wz AS (SELECT gene, grp, n1, (n - n1)::BIGINT AS n2, w, (w - n1 * (n - n1) / 2 - 0.5::DOUBLE * sign(w - n1 * (n - n1) / 2)) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM ws JOIN tie USING (gene))",
    ]
    marked = "marked AS (SELECT DISTINCT gene FROM shares WHERE logfc > 0.005::DOUBLE)"
    sides = (
        "side AS (SELECT gene AS name, true AS measured, gene IN (SELECT gene FROM marked) AS marked FROM genes UNION ALL "
        "SELECT name, bool_and(member IN (SELECT gene FROM genes)), bool_or(member IN (SELECT gene FROM marked)) FROM complex WHERE member <> '' GROUP BY 1)"
    )
    region = _region("", "apart", 60)
    tail = {
        "norm_log1p": "SELECT cell, gene, " + _r("value") + " FROM norm",
        "global_max_scale": "SELECT cell, gene, " + _r("value") + " FROM expr",
        "scale_zscore": "SELECT cell, gene, " + _r("(value - m) / sd", "value") + " FROM expr JOIN (SELECT gene, avg(v) AS m, stddev_samp(v) AS sd FROM dense GROUP BY 1) USING (gene)",
        "scale_l1": "SELECT cell, gene, " + _r("value / sum(abs(value)) OVER (PARTITION BY gene)", "value") + " FROM expr",
        "avg_tri": group_mean(_TRI),
        "avg_truncated": truncated,
        "avg_thresholded": group_mean(thresholded),
        "avg_median": group_mean("median(v)"),
        "avg_mean": group_mean("avg(v)"),
        "kb_subset": "SELECT lr_ix, interaction_name, annotation FROM lr WHERE annotation IN ('Secreted Signaling', 'ECM-Receptor', 'Cell-Cell Contact')",
        "kb_order": f"SELECT row_number() OVER (ORDER BY list_position([{levels}], annotation), lr_ix)::INT AS ord, interaction_name FROM lr WHERE annotation IN ({levels})",
        "kb_extract_genes": "SELECT gene, row_number() OVER (ORDER BY spot)::INT AS ord FROM (SELECT coalesce(p.member, n.name) AS gene, min(struct_pack(o := n.role * 1000000 + n.lr_ix, p := coalesce(p.pos, 0), g := coalesce(p.member, n.name))) AS spot "
        "FROM (SELECT lr_ix, unnest(range(0, 6)) AS role, unnest([ligand, receptor, agonist, antagonist, co_a, co_i]) AS name FROM lr) n LEFT JOIN (SELECT * FROM complex UNION ALL SELECT * FROM cofactor) p ON p.name = n.name AND p.member <> '' WHERE n.name <> '' GROUP BY 1)",
        "kb_search_pair": "SELECT row_number() OVER (ORDER BY pathway_name = 'PA', lr_ix)::INT AS ord, interaction_name FROM lr WHERE pathway_name IN ('PC', 'PA')",
        "kb_pairs_of_genes": f"SELECT row_number() OVER (ORDER BY side, lr_ix)::INT AS ord, interaction_name FROM (SELECT lr_ix, min(side) AS side FROM ({found}) GROUP BY 1) JOIN lr USING (lr_ix)",
        "kb_category": "SELECT annotation, count(*) AS n, count(*) FILTER (ligand IN (SELECT name FROM complex) OR receptor IN (SELECT name FROM complex)) AS n_complex, " + _r("count(*) / sum(count(*)) OVER ()", "share") + " FROM lr GROUP BY annotation",
        "lr_expr": "SELECT lr_ix, grp, " + _r("l.value", "ligand") + ", " + _r("r.value", "receptor") + " FROM o_ligand l JOIN o_receptor r USING (lr_ix, grp)",
        "coreceptor_a": "SELECT lr_ix, grp, " + _r("value") + " FROM o_co_a",
        "coreceptor_i": "SELECT lr_ix, grp, " + _r("value") + " FROM o_co_i",
        "agonist": "SELECT lr_ix, grp, " + _r("value") + " FROM o_agonist",
        "antagonist": "SELECT lr_ix, grp, " + _r("value") + " FROM o_antagonist",
        "commun_prob": f"SELECT lr_ix, src, tgt, {kept_net} FROM o_prob",
        "commun_prob_population": (pop, f"SELECT lr_ix, src, tgt, {kept_net} FROM pp"),
        "commun_pval": f"SELECT lr_ix, src, tgt, {kept_net}, pval FROM seen",
        "filter_min_cells": "SELECT lr_ix, src, tgt, CASE WHEN src IN (SELECT grp FROM few) OR tgt IN (SELECT grp FROM few) THEN 0 ELSE round(prob, 6) + 0.0::DOUBLE END::DOUBLE AS prob FROM seen",
        "filter_min_samples": (support, "SELECT lr_ix, src, tgt, CASE WHEN partly AND n < 2 THEN 0 ELSE round(prob, 6) + 0.0::DOUBLE END::DOUBLE AS prob FROM (SELECT s.*, coalesce(n, 0) AS n, bool_or(coalesce(n, 0) > 0 AND coalesce(n, 0) < 2) OVER (PARTITION BY s.lr_ix) AS partly FROM seen s LEFT JOIN support USING (lr_ix, src, tgt))"),
        "aggregate_net": "SELECT src, tgt, count, " + _r("weight") + " FROM agg",
        "aggregate_net_filtered": "SELECT src, tgt, count(*) AS count, " + _r("sum(prob)", "weight") + " FROM seen WHERE pval < 0.05 AND prob > 0 AND src IN ('BUILDING', 'MACHINERY') AND lr_ix <= 4 GROUP BY src, tgt",
        "pathway_prob": f"SELECT pathway_ix, pathway_name, src, tgt, {kept_net} FROM netp",
        "subset_comm": f"SELECT src, tgt, ligand, receptor, {kept_net}, pval, interaction_name, pathway_name, annotation FROM kept",
        "subset_comm_netp": "SELECT src, tgt, pathway_name, " + _r("sum(prob)", "prob") + ", " + _r("avg(pval)", "pval") + " FROM kept GROUP BY 1, 2, 3",
        "find_enriched": f"SELECT src, tgt, interaction_name, {kept_net} FROM kept WHERE (ligand IN ('Brand#1', 'CX1') OR receptor IN ('Brand#1', 'CX1')) AND (src = 'BUILDING' OR tgt = 'BUILDING')",
        "pairwise_rank": "SELECT lr_ix, src, tgt, row_number() OVER (PARTITION BY src, tgt ORDER BY pval, round(prob, 9) DESC, lr_ix)::INT AS rnk FROM seen",
        "enriched_interactions": "SELECT lr_ix, src, tgt, CASE WHEN pval > 0.05 THEN 0 ELSE round(prob, 6) END::DOUBLE AS prob, CASE WHEN pval > 0.05 THEN 1 WHEN pval > 0.01 THEN 2 ELSE 3 END::INT AS band FROM seen WHERE pval < 0.05 AND ((src = 'BUILDING' AND tgt = 'MACHINERY') OR (tgt = 'BUILDING' AND src = 'MACHINERY'))",
        "enriched_pairs": "SELECT lr_ix, interaction_name, " + _r("sum(CASE WHEN pval >= 0.05 THEN 0 ELSE prob END)", "total") + " FROM seen JOIN lr USING (lr_ix) WHERE pathway_name = 'PB' GROUP BY 1, 2 HAVING sum(CASE WHEN pval >= 0.05 THEN 0 ELSE prob END) <> 0",
        "contribution": "SELECT interaction_name, " + _r("s / sum(s) OVER ()", "contribution") + " FROM (SELECT interaction_name, sum((p - lo) / (hi - lo)) AS s FROM (SELECT *, min(p) OVER () AS lo, max(p) OVER () AS hi FROM (SELECT *, CASE WHEN pval > 0.05 THEN 0 ELSE prob END AS p FROM seen)) JOIN lr USING (lr_ix) WHERE pathway_name = 'PA' GROUP BY 1)",
        "rank_net": ([_flow("netp")], "SELECT pathway_name, " + _r("total") + ", " + _r("flow") + " FROM flow"),
        "rank_net_compare": (["both_p AS (SELECT * FROM datasets JOIN lr USING (lr_ix))", _flow("both_p", "dataset")], "SELECT pathway_name, round(a, 6) + 0.0::DOUBLE AS flow_0, round(b, 6) + 0.0::DOUBLE AS flow_1, round(CASE WHEN a > 0 THEN b / a END, 6) + 0.0::DOUBLE AS ratio FROM (SELECT pathway_name, coalesce(max(flow) FILTER (dataset = 0), 0) AS a, coalesce(max(flow) FILTER (dataset = 1), 0) AS b FROM flow GROUP BY 1)"),
        "compare_totals": "SELECT dataset::INT AS dataset, count(*) FILTER (prob > 0) AS count, " + _r("sum(prob)", "weight") + " FROM datasets GROUP BY 1",
        "diff_net": "SELECT src, tgt, count(*) FILTER (dataset = 1 AND prob > 0) - count(*) FILTER (dataset = 0 AND prob > 0) AS count, " + _r("sum(CASE WHEN dataset = 1 THEN prob ELSE 0 END) - sum(CASE WHEN dataset = 0 THEN prob ELSE 0 END)", "weight") + " FROM datasets GROUP BY 1, 2",
        "max_weight": "SELECT " + _r("max(w)", "weight") + " FROM (SELECT sum(prob) AS w FROM datasets GROUP BY dataset, src, tgt)",
        "merge_groups": "SELECT CASE WHEN length(src) > 9 THEN 'long' ELSE 'short' END AS src, CASE WHEN length(tgt) > 9 THEN 'long' ELSE 'short' END AS tgt, sum(count)::BIGINT AS count, " + _r("sum(weight)", "weight") + " FROM agg GROUP BY 1, 2",
        "bubble": f"SELECT src || ' -> ' || tgt AS source_target, interaction_name, {kept_net}, CASE WHEN pval > 0.05 THEN 1 WHEN pval > 0.01 THEN 2 ELSE 3 END::INT AS band FROM kept",
        "lift": "SELECT lr_ix, a.grp AS src, b.grp AS tgt, coalesce(round(prob, 6) + 0.0::DOUBLE, 0) AS prob, coalesce(pval, 1)::DOUBLE AS pval FROM (SELECT DISTINCT lr_ix FROM seen) CROSS JOIN (SELECT DISTINCT grp FROM cells UNION ALL SELECT 'NEW') a CROSS JOIN (SELECT DISTINCT grp FROM cells UNION ALL SELECT 'NEW') b LEFT JOIN seen s USING (lr_ix) WHERE 1 = 0",
        "score_import": "SELECT lr_ix, src, tgt, " + _r("CASE WHEN src = tgt THEN prob ELSE prob * 2 END", "prob") + ", 0.0::DOUBLE AS pval FROM seen",
        "de_pct_fc": "SELECT gene, grp, pct_1 + 0.0::DOUBLE AS pct_1, pct_2 + 0.0::DOUBLE AS pct_2, " + _r("logfc") + " FROM shares",
        "wilcox_w": (wil, "SELECT gene, grp, n1, n2, w::DOUBLE AS w, " + _r("z") + " FROM wz"),
        "de_expressed": "SELECT gene, count(*) AS n FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) >= 100",
        "lr_overexpressed": ([marked, sides], "SELECT l.lr_ix, interaction_name FROM lr l JOIN side a ON a.name = l.ligand JOIN side b ON b.name = l.receptor WHERE a.measured AND b.measured AND a.marked AND b.marked"),
        "map_deg": "SELECT src, tgt, interaction_name, " + ", ".join(_r(c) for c in ("ligand_logfc", "ligand_pct_1", "receptor_logfc", "receptor_pct_2")) + " FROM mapped",
        "enrichment": "SELECT pathway_name, round(sum(s) * 1000000, 3) + 0.0::DOUBLE AS score FROM (SELECT lr_ix, pathway_name, avg(abs(ligand_logfc) * abs(receptor_logfc) * abs(ligand_pct_1 - ligand_pct_2) * abs(receptor_pct_1 - receptor_pct_2)) AS s FROM mapped GROUP BY 1, 2) GROUP BY 1",
        "degree_strength": "SELECT pathway_name, grp, outdeg_unweighted, indeg_unweighted, " + _r("outdeg") + ", " + _r("indeg") + " FROM degree",
        "signaling_role": "SELECT pathway_name, grp, " + _r("outdeg / max(outdeg) OVER w", "outgoing") + ", " + _r("indeg / max(indeg) OVER w", "incoming") + " FROM degree WINDOW w AS (PARTITION BY pathway_name)",
        "role_scatter": "SELECT grp, " + _r("sum(outdeg)", "x") + ", " + _r("sum(indeg)", "y") + ", (sum(outdeg_unweighted) + sum(indeg_unweighted) - (SELECT count(*) FROM netp z WHERE prob > 0 AND src = tgt AND src = d.grp))::BIGINT AS n FROM degree d GROUP BY grp",
        "similarity_functional": (_similar("SELECT pathway_name AS name, src, tgt FROM netp WHERE prob > 0"), _SMOOTHED),
        "knn_topk": "SELECT sample, node, neighbour, rnk, " + _r("d") + " FROM near WHERE rnk <= 5",
        "snn": (["nb AS (SELECT node, neighbour FROM near WHERE rnk <= 4 UNION ALL SELECT cell, cell FROM place)"], "SELECT i, j, round(w, 6) + 0.0::DOUBLE AS w FROM (SELECT a.node AS i, b.node AS j, CASE WHEN a.node = b.node THEN 1.0::DOUBLE ELSE count(*) / (10 - count(*)) END AS w FROM nb a JOIN nb b USING (neighbour) GROUP BY 1, 2) WHERE w >= 1 / 15"),
        "cell_distance": "SELECT sample, i, j, " + _r("d") + " FROM apart WHERE i < j AND d <= 20.5",
        "region_distance": (region, "SELECT x.a AS src, x.b AS tgt, round(CASE WHEN x.adj * y.adj = 1 THEN (x.d + y.d) / 2 END, 6) + 0.0::DOUBLE AS d, x.adj * y.adj AS adjacent FROM rb x JOIN rb y ON x.a = y.b AND x.b = y.a"),
        "merge_datasets": "SELECT 'd' || sample AS dataset, grp, count(*) AS n, " + _r("sum(value)", "total") + " FROM raw JOIN cells USING (cell) GROUP BY 1, 2",
        "window_means": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS grp, count(*) AS n, count(*) FILTER (value <> 0) AS nnz, " + _r("sum(value) / count(*)", "mean") + " FROM events GROUP BY 1, 2",
    }
    overlap = [
        region[0],
        "kn AS (SELECT DISTINCT r.sample, c.grp AS a, r.neighbour AS nn FROM near r JOIN place c ON c.cell = r.node WHERE rnk <= 5)",
        "hit AS (SELECT a, b FROM (SELECT DISTINCT sample, a, b, nn FROM nn WHERE d < 60) JOIN kn USING (sample, a, nn) GROUP BY sample, a, b HAVING count(*) >= 2)",
    ]
    tail["contact_overlap"] = (overlap, "SELECT DISTINCT a AS src, b AS tgt, ((a, b) IN (SELECT (a, b) FROM hit) AND (b, a) IN (SELECT (a, b) FROM hit))::INT AS adjacent FROM nn")
    joined = "rd AS (SELECT x.a AS src, x.b AS tgt, CASE WHEN x.adj * y.adj = 1 THEN (x.d + y.d) / 2 END AS d FROM rb x JOIN rb y ON x.a = y.b AND x.b = y.a)"
    tail["spatial_weight"] = ([*region, joined, "rw AS (SELECT *, CASE WHEN src <> tgt AND d > 0 THEN 1 / (d * 0.01::DOUBLE) END AS w FROM rd)"], "SELECT src, tgt, " + _r("CASE WHEN src = tgt THEN coalesce(max(w) OVER (), 0) ELSE coalesce(w, 0) END", "weight") + " FROM rw")
    spots = [
        "home AS (SELECT c_custkey AS cell, c_mktsegment AS grp, (c_custkey % 2)::INT AS sample, c_acctbal::DOUBLE AS x, (c_nationkey * 400)::DOUBLE AS y FROM customer)",
        "apart_c AS (SELECT a.sample, a.cell AS i, b.cell AS j, a.grp AS a, b.grp AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM home a JOIN home b ON a.sample = b.sample)",
        *_region("c_", "apart_c", 250),
        "c_rd AS (SELECT x.a AS src, x.b AS tgt, x.adj * y.adj AS contact, CASE WHEN x.adj * y.adj = 1 THEN (x.d + y.d) / 2 END AS d FROM c_rb x JOIN c_rb y ON x.a = y.b AND x.b = y.a)",
        "c_rw AS (SELECT *, CASE WHEN src <> tgt AND d > 0 THEN 1 / (d * 0.01::DOUBLE) END AS w FROM c_rd)",
        "c_sw AS (SELECT src, tgt, contact, CASE WHEN src = tgt THEN coalesce(max(w) OVER (), 0) ELSE coalesce(w, 0) END AS weight FROM c_rw)",
    ]
    tail["commun_prob_contact"] = (spots, "SELECT lr_ix, src, tgt, " + _r("prob * weight * CASE WHEN lr_ix > (SELECT max(lr_ix) FROM lr WHERE annotation <> 'Cell-Cell Contact') THEN contact ELSE 1 END", "prob") + " FROM o_prob JOIN c_sw USING (src, tgt)")
    paths = "dp AS (SELECT dataset, pathway_name, src, tgt, sum(prob) AS prob FROM datasets JOIN lr USING (lr_ix) GROUP BY ALL)"
    tail["chord_edges"] = (
        ["ch AS (SELECT src, tgt, ligand || ' - ' || receptor AS name, sum(prob) AS prob FROM kept GROUP BY 1, 2, 3)"],
        "SELECT src, tgt, name, " + ", ".join(_r(f"coalesce(sum(prob) OVER (PARTITION BY {s} ORDER BY round(prob, 9) DESC, src, tgt, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", n) for s, n in (("src", "start"), ("tgt", "\"end\""))) + ", " + _r("prob") + " FROM ch",
    )
    tail["side_markers"] = (
        ["mk AS (SELECT gene, grp FROM shares WHERE logfc > 0.005::DOUBLE)", "sn AS (SELECT ligand AS name FROM lr UNION SELECT receptor FROM lr)"],
        "SELECT gene AS name, gene, grp FROM mk WHERE gene IN (SELECT name FROM sn) UNION ALL SELECT DISTINCT c.name, gene, grp FROM mk JOIN complex c ON c.member = gene WHERE gene NOT IN (SELECT name FROM sn)",
    )
    tail["filter_rare_kept"] = (
        [
            *support,
            "sg AS (SELECT s.sample, g.grp, count(c.cell) AS n FROM (SELECT DISTINCT sample FROM cells) s CROSS JOIN (SELECT grp FROM cells GROUP BY 1 HAVING count(*) > 100) g LEFT JOIN cells c ON c.sample = s.sample AND c.grp = g.grp GROUP BY 1, 2)",
            "rare AS (SELECT DISTINCT grp FROM sg WHERE n <= 100)",
        ],
        "SELECT lr_ix, src, tgt, CASE WHEN partly AND n < 2 AND src NOT IN (SELECT grp FROM rare) AND tgt NOT IN (SELECT grp FROM rare) THEN 0 ELSE round(prob, 6) + 0.0::DOUBLE END::DOUBLE AS prob "
        "FROM (SELECT s.*, coalesce(n, 0) AS n, bool_or(coalesce(n, 0) > 0 AND coalesce(n, 0) < 2) OVER (PARTITION BY s.lr_ix) AS partly FROM seen s LEFT JOIN support USING (lr_ix, src, tgt))",
    )
    tail["role_changes"] = (
        [paths, "dg AS (SELECT pathway_name, grp, sum(o0) AS o0, sum(o1) AS o1, sum(i0) AS i0, sum(i1) AS i1 FROM (SELECT pathway_name, src AS grp, CASE dataset WHEN 0 THEN prob ELSE 0 END AS o0, CASE dataset WHEN 1 THEN prob ELSE 0 END AS o1, 0 AS i0, 0 AS i1 FROM dp WHERE prob > 0 "
         "UNION ALL SELECT pathway_name, tgt, 0, 0, CASE dataset WHEN 0 THEN prob ELSE 0 END, CASE dataset WHEN 1 THEN prob ELSE 0 END FROM dp WHERE prob > 0) GROUP BY 1, 2)"],
        "SELECT pathway_name, grp, " + _r("o1 - o0", "outgoing") + ", " + _r("i1 - i0", "incoming") + ", CASE WHEN o0 + i0 > 0 AND o1 + i1 > 0 THEN 'shared' WHEN o1 + i1 > 0 THEN 'second' WHEN o0 + i0 > 0 THEN 'first' ELSE 'neither' END AS class FROM dg",
    )
    named = "nm AS (SELECT unnest([ligand, receptor, agonist, antagonist, co_a, co_i]) AS name FROM lr), pt AS (SELECT * FROM complex UNION ALL SELECT * FROM cofactor), used AS (SELECT DISTINCT coalesce(p.member, n.name) AS gene FROM nm n LEFT JOIN pt p ON p.name = n.name AND p.member <> '' WHERE n.name <> '')"
    tail["subset_expression"] = ([named], "SELECT cell, gene, " + _r("value") + " FROM expr WHERE gene IN (SELECT gene FROM used)")
    tail["subset_groups"] = "SELECT CASE WHEN grp IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE grp END AS grp, count(DISTINCT cell) AS n, " + _r("sum(value)", "total") + " FROM raw JOIN cells USING (cell) WHERE grp IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1"
    tail["mean_by_sample"] = "SELECT gene, sample, grp, " + _r("avg(v)", "value") + " FROM dense GROUP BY 1, 2, 3"
    tail["max_weights"] = "SELECT max(c) AS count, " + _r("max(w)", "weight") + " FROM (SELECT count(*) FILTER (prob > 0) AS c, sum(prob) AS w FROM datasets GROUP BY dataset, src, tgt)"
    tail["similarity_pairwise"] = ([paths, *_similar("SELECT pathway_name || '--' || dataset AS name, src, tgt FROM dp WHERE prob > 0")], _SMOOTHED)
    tail["rank_similarity"] = ([paths, "spot AS (SELECT dataset, pathway_name, sum(prob) AS s, max(prob) AS m FROM dp GROUP BY 1, 2)"], "SELECT pathway_name, " + _r("sqrt(pow(p.s - q.s, 2) + pow(p.m - q.m, 2))", "distance") + " FROM spot p JOIN spot q USING (pathway_name) WHERE p.dataset = 0 AND q.dataset = 1")
    tail["rank_net_test"] = (
        [
            paths,
            "df AS (SELECT pathway_name, round(sum(CASE WHEN dataset = 1 THEN prob ELSE 0 END) - sum(CASE WHEN dataset = 0 THEN prob ELSE 0 END), 9) AS d FROM dp GROUP BY pathway_name, src, tgt)",
            "sr AS (SELECT *, count(*) OVER (PARTITION BY pathway_name, abs(d)) AS t, rank() OVER (PARTITION BY pathway_name ORDER BY abs(d)) AS r FROM df WHERE d <> 0)",
            "sv AS (SELECT pathway_name, count(*) AS n, sum(CASE WHEN d > 0 THEN r + (t - 1) / 2 ELSE 0 END)::DOUBLE AS v, sum(t * t - 1)::DOUBLE AS ties FROM sr GROUP BY 1)",
        ],
        "SELECT pathway_name, n, " + _r("v") + ", " + _r("(v - n * (n + 1) / 4 - 0.5::DOUBLE * sign(v - n * (n + 1) / 4)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)", "z") + ", (SELECT count(*) FROM df WHERE df.pathway_name = sv.pathway_name AND d = 0) AS zeros, ties > 0 AS tied FROM sv",
    )
    tail["heatmap"] = "SELECT src, tgt, " + _r("weight", "value") + ", " + _r("sum(weight) OVER (PARTITION BY src)", "sent") + ", " + _r("sum(weight) OVER (PARTITION BY tgt)", "received") + " FROM agg"
    tail["pathway_entropy"] = "SELECT pathway_name, " + _r("-sum(CASE WHEN p > 0 THEN p * ln(p) END)", "entropy") + " FROM (SELECT pathway_name, prob / sum(prob) OVER (PARTITION BY pathway_name) AS p FROM netp) GROUP BY 1"
    plain = "plain AS (SELECT gene, grp, sum(v) / count(*) - (sum(sum(v)) OVER w - sum(v)) / (sum(count(*)) OVER w - count(*)) AS gap FROM dense GROUP BY gene, grp WINDOW w AS (PARTITION BY gene))"
    tail["de_fast"] = ([*wil, plain], "SELECT gene, grp, " + _r("gap", "logfc") + ", " + _r("pct_1 * 100", "pct_1") + ", " + _r("pct_2 * 100", "pct_2") + ", " + _r("z") + " FROM plain JOIN shares USING (gene, grp) JOIN wz USING (gene, grp) WHERE greatest(pct_1, pct_2) > 0 AND z IS NOT NULL")
    tail["de_datasets"] = (
        [
            "dr AS (SELECT *, rank() OVER (PARTITION BY gene, grp ORDER BY v) + (count(*) OVER (PARTITION BY gene, grp, v) - 1) / 2 AS r FROM dense)",
            "dt AS (SELECT gene, grp, sum(t * t * t - t) AS t, sum(t) AS n FROM (SELECT gene, grp, v, count(*)::DOUBLE AS t FROM dense GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            "dw AS (SELECT gene, grp, count(*) FILTER (sample = 1) AS n1, count(*) FILTER (sample = 0) AS n2, count(*) FILTER (sample = 1 AND v > 0) AS k1, count(*) FILTER (sample = 0 AND v > 0) AS k2, "
            "sum(exp(v) - 1) FILTER (sample = 1) AS s1, sum(exp(v) - 1) FILTER (sample = 0) AS s2, sum(r) FILTER (sample = 1) - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS g FROM dr GROUP BY 1, 2)",
        ],
        "SELECT gene, grp, round(k1 / n1, 3) + 0.0::DOUBLE AS pct_1, round(k2 / n2, 3) + 0.0::DOUBLE AS pct_2, " + _r("ln(s1 / n1 + 1) - ln(s2 / n2 + 1)", "logfc") + ", "
        + _r("(g - 0.5::DOUBLE * sign(g)) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1))))", "z") + " FROM dw JOIN dt USING (gene, grp)",
    )
    tail["min_max_threshold"] = "SELECT cell, gene, " + _r("x", "value") + " FROM (SELECT cell, gene, CASE WHEN max(value) OVER g > min(value) OVER g THEN (value - min(value) OVER g) / (max(value) OVER g - min(value) OVER g) ELSE 0 END AS x FROM raw WINDOW g AS (PARTITION BY gene)) WHERE x >= 0.5"
    asked = "asked(name, ord) AS (VALUES ('CX1', 1), ('Brand#2', 2), ('CX3', 3), ('Brand#1', 4))"
    official = "official AS (SELECT DISTINCT p_brand AS symbol FROM part)"
    tail["kb_gene_subset"] = (
        [asked, official],
        "SELECT gene, row_number() OVER (ORDER BY min(spot))::INT AS ord FROM (SELECT name AS gene, (0, 0, ord) AS spot FROM asked WHERE name IN (SELECT symbol FROM official) UNION ALL "
        "SELECT member, (1, pos, ord) FROM asked JOIN complex USING (name) WHERE member <> '' AND name NOT IN (SELECT symbol FROM official)) GROUP BY gene",
    )
    tail["kb_check_symbols"] = ([official], "SELECT member AS gene FROM cofactor WHERE member NOT IN (SELECT symbol FROM official)")
    tail["kb_update"] = "SELECT lr_ix, interaction_name, ligand, pathway_name FROM lr UNION ALL SELECT (SELECT max(lr_ix) + 1 FROM lr)::INT, 'NEW', 'Brand#20', ''"
    edges = [
        "ed AS (SELECT ligand AS g1, receptor AS g2 FROM lr WHERE ligand LIKE 'Brand%' AND receptor LIKE 'Brand%')",
        "st AS (SELECT g1, g2, 1 / count(*) OVER (PARTITION BY g1) AS w FROM (SELECT g1, g2 FROM ed UNION SELECT g2, g1 FROM ed))",
        # the walk with restart until 2^-45 of the values are left, far below what is rounded
        "k0 AS (SELECT DISTINCT g1 AS a, g1 AS b, 1.0::DOUBLE AS v FROM st)",
    ]
    for k in range(1, 46):
        edges.append(f"k{k} AS MATERIALIZED (SELECT a, b, sum(v) AS v FROM (SELECT g1 AS a, g1 AS b, 0.5::DOUBLE AS v FROM (SELECT DISTINCT g1 FROM st) UNION ALL SELECT g1, b, v * w * 0.5::DOUBLE FROM k{k - 1} JOIN st ON g2 = a) GROUP BY 1, 2)")
    tail["smooth"] = (
        edges,
        "SELECT cell, gene, " + _r("value") + " FROM (SELECT cell, a AS gene, sum(value * v) AS value FROM expr JOIN k45 ON gene = b WHERE a IN (SELECT gene FROM genes) GROUP BY 1, 2 "
        "UNION ALL SELECT cell, gene, value FROM expr WHERE gene NOT IN (SELECT g1 FROM st))",
    )
    few = "few AS (SELECT grp FROM cells GROUP BY grp HAVING count(*) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM cells GROUP BY grp)))"
    tail["filter_min_cells"] = ([few], tail["filter_min_cells"])
    tail["lift"] = (
        ["grp_all AS (SELECT DISTINCT grp FROM cells UNION ALL SELECT 'NEW')"],
        "SELECT i.lr_ix, a.grp AS src, b.grp AS tgt, coalesce(round(prob, 6) + 0.0::DOUBLE, 0) AS prob, coalesce(round(pval, 6), 1)::DOUBLE AS pval "
        "FROM (SELECT DISTINCT lr_ix FROM seen) i CROSS JOIN grp_all a CROSS JOIN grp_all b LEFT JOIN seen s ON s.lr_ix = i.lr_ix AND s.src = a.grp AND s.tgt = b.grp",
    )
    base = _base()
    return {k: base + (",\n" + ",\n".join(v[0]) + "\n" + v[1] if isinstance(v, tuple) else "\n" + v) for k, v in tail.items()}
