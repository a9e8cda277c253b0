"""Reference SQL: shared common table expressions and the text of each check query."""

from __future__ import annotations

from .bridge import DATASETS, MODELS, PRICES, PRODUCT_MODELS, PRODUCTS, WAVES
from ..functions import tables as T


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) {name}({columns})"


def case(expr: str, mapping: dict, default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def hex8(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"


def private(dataset: str, key: str) -> str:
    base = f"split_part({dataset}, ' ', 1)"
    pct = case(base, T.HOLDOUT_PERCENT, "0")
    return f"({hex8(base + ' || ' + q(':') + ' || ' + key)} % 100 < {pct})"


def topic_case(text: str) -> str:
    arms = []
    for name, words in T.TOPICS.items():
        test = " OR ".join(f"contains(lower({text}), {q(w)})" for w in words)
        arms.append(f"WHEN {test} THEN {q(name)}")
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN NULL " + " ".join(arms) + f" ELSE {q(T.FALLBACK_TOPIC)} END"


def jsd_of(p: str, qq: str) -> str:
    """Aggregate over option rows of two normalised columns."""
    return (
        f"greatest(0e0, sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {qq}) / 2e0)) ELSE 0e0 END"
        f" + CASE WHEN {qq} > 0 THEN {qq} * log2({qq} / (({p} + {qq}) / 2e0)) ELSE 0e0 END) / 2e0)"
    )


def parity_of(jsd: str, tau: str) -> str:
    return (
        f"(0.5e0 * (1e0 - greatest(0e0, least(1e0, {jsd})))"
        f" + 0.5e0 * ((greatest(-1e0, least(1e0, {tau})) + 1e0) / 2e0))"
    )


def tau_cte(source: str, keys: str, p: str = "p_human", m: str = "p_model") -> str:
    """(keys, tau) from option rows via a self join on the option order."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return (
        f"SELECT {cols}, CASE WHEN sum(abs(sign(a.{p} - b.{p}))) * sum(abs(sign(a.{m} - b.{m}))) = 0 THEN 0e0"
        f" ELSE sum(sign(a.{p} - b.{p}) * sign(a.{m} - b.{m}))"
        f" / sqrt(CAST(sum(abs(sign(a.{p} - b.{p}))) * sum(abs(sign(a.{m} - b.{m}))) AS DOUBLE)) END AS tau"
        f" FROM {source} a JOIN {source} b ON {on} AND a.option < b.option GROUP BY {cols}"
    )


YEAR_OF_SURVEY = "CASE regexp_extract(survey, '^ATP W([0-9]+)$', 1) " + " ".join(
    f"WHEN '{w}' THEN {y}" for w, y in T.WAVE_YEARS.items()
) + " ELSE 0 END"

CODE = "l_returnflag || l_linestatus"
CTES: dict[str, tuple[list[str], str]] = {
    "parts": ([], f"SELECT 'P' || p_partkey AS key, p_partkey, {case('p_type', DATASETS)} AS dataset,"
                  " 'ATP W' || p_size AS survey, p_name, p_brand, p_size FROM part"),
    "base": (["parts"], f"""
        SELECT l_orderkey AS sample_no, 'm' || l_linenumber AS model, key, dataset,
               dataset || '_m' || l_linenumber AS run_id,
               CASE WHEN l_discount >= 0.1e0 THEN 'Refused' ELSE {CODE} END AS option,
               CASE WHEN l_tax >= 0.08e0 THEN 'Other' ELSE {CODE} END AS selected_option,
               l_discount >= 0.1e0 AS refusal,
               CASE WHEN l_quantity < 5 THEN '' ELSE 'Answer: ' || {CODE} END AS raw_text,
               CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS in_tok,
               CASE WHEN l_tax > 0 THEN CAST(round(l_tax * 100) AS BIGINT) END AS out_tok,
               l_shipdate AS ts
        FROM lineitem JOIN parts ON l_partkey = p_partkey"""),
    "qopt": (["base"], """
        SELECT dataset, key, option, n, n / sum(n) OVER (PARTITION BY key) AS p_human,
               count(*) OVER (PARTITION BY key) AS k
        FROM (SELECT dataset, key, option, count(*) AS n FROM base GROUP BY ALL)"""),
    "cells": (["base"], """
        SELECT run_id, dataset, key, min(model) AS model,
               count(*) FILTER (NOT refusal) AS answered, count(*) FILTER (refusal) AS refused,
               CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok,
               count(in_tok) AS calls
        FROM base GROUP BY run_id, dataset, key"""),
    "mopt": (["base"], "SELECT run_id, key, selected_option AS option, count(*) AS c FROM base WHERE NOT refusal GROUP BY ALL"),
    "rawlong": (["qopt", "cells", "mopt"], """
        SELECT c.run_id, c.dataset, c.key, c.model, qo.option, qo.k, qo.p_human, coalesce(m.c, 0) AS c,
               coalesce(m.c, 0) / greatest(c.answered + c.refused, 1) AS p_raw
        FROM cells c JOIN qopt qo ON c.key = qo.key
        LEFT JOIN mopt m ON m.run_id = c.run_id AND m.key = c.key AND m.option = qo.option"""),
    "long": (["rawlong"], """
        SELECT *, CASE WHEN s > 0 THEN p_raw / s ELSE 1e0 / k END AS p_model
        FROM (SELECT *, sum(p_raw) OVER (PARTITION BY run_id, key) AS s FROM rawlong)"""),
    "taus": (["long"], tau_cte("long", "run_id, key")),
    "jsds": (["long"], f"""
        SELECT run_id, key, {jsd_of('p_human', 'p_model')} AS jsd,
               sum(CASE WHEN regexp_matches(option, '(?i)\\brefused?\\b|\\bdon''?t know\\b') THEN p_human ELSE 0e0 END) AS human_refusal_rate,
               CAST(sum(c) AS BIGINT) AS valid_n, count(*) AS k
        FROM long GROUP BY run_id, key"""),
    "scored": (["cells", "taus", "jsds"], f"""
        SELECT *, {parity_of('jsd', 'tau')} AS parity FROM (
        SELECT c.run_id, c.dataset, c.key, c.model, j.jsd, coalesce(t.tau, 0e0) AS tau,
               c.answered + c.refused AS n_samples, c.answered - j.valid_n AS n_parse_failures,
               c.refused / greatest(c.answered + c.refused, 1) AS model_refusal_rate, j.human_refusal_rate,
               c.in_tok, c.out_tok, c.calls, j.k
        FROM cells c JOIN jsds j USING (run_id, key) LEFT JOIN taus t USING (run_id, key))"""),
    "runscore": (["scored"], f"""
        SELECT *, (p_dist + p_rank + p_refuse) / 3e0 AS sps, {parity_of('mean_jsd', 'mean_tau')} AS composite_parity FROM (
        SELECT run_id, dataset, min(model) AS model, count(*) AS n_questions, avg(jsd) AS mean_jsd, avg(tau) AS mean_tau,
               quantile_cont(jsd, 0.5) AS median_jsd,
               greatest(0e0, least(1e0, 1e0 - avg(abs(model_refusal_rate - human_refusal_rate)))) AS p_refuse,
               1e0 - avg(jsd) AS p_dist, (1e0 + avg(tau)) / 2e0 AS p_rank
        FROM scored GROUP BY run_id, dataset)"""),
    "models": ([], values([(m, p, t, tpl, n) for m, p, t, tpl, n in MODELS], "model, provider, temperature, template, samples_per_question", "v")),
    "names": ([], values(T.MODEL_NAMES + PRODUCTS, "path, display_name, family", "v")),
    "prices": ([], values(PRICES, "path, in_price, out_price", "v")),
    "policies": ([], values([(a, b) for a, b, _ in T.POLICIES], "dataset, tier", "v")),
    "productraw": ([], values(PRODUCT_MODELS, "product, raw_name", "v")),
    "cfg": (["models", "names"], """
        SELECT m.*, coalesce(n1.display_name, n2.display_name, n3.display_name, provider) AS display_name,
               coalesce(n1.family, n2.family, n3.family, CASE WHEN provider IN ('random-baseline', 'majority-baseline') THEN 'baseline' END, 'raw') AS family
        FROM (SELECT *, trim(split_part(split_part(split_part(provider, ' t=', 1), ' tpl=', 1), ' profile=', 1)) AS bare FROM models) m
        LEFT JOIN names n1 ON n1.path = m.provider
        LEFT JOIN names n2 ON n2.path = m.bare
        LEFT JOIN names n3 ON n3.path = CASE WHEN regexp_matches(m.bare, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$')
             THEN regexp_replace(m.bare, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '') ELSE regexp_replace(m.bare, '-[0-9]{8}$', '') END"""),
    "runs": (["runscore", "cfg", "base"], """
        SELECT r.*, c.provider, c.temperature, c.template, c.samples_per_question, c.display_name, c.family, t.ts, u.input_tokens, u.output_tokens
        FROM runscore r JOIN cfg c ON c.model = r.model
        JOIN (SELECT run_id, max(ts) AS ts FROM base GROUP BY run_id) t ON t.run_id = r.run_id
        JOIN (SELECT run_id, CAST(sum(in_tok) AS BIGINT) AS input_tokens, CAST(sum(out_tok) AS BIGINT) AS output_tokens FROM scored GROUP BY run_id) u ON u.run_id = r.run_id"""),
    "texts": ([], "SELECT 'P' || doc_id AS key, text FROM documents"),
    "topics": (["texts"], f"SELECT key, text, {topic_case('text')} AS topic FROM texts"),
    "qtopics": (["parts", "texts"], f"SELECT key, {topic_case('text')} AS topic FROM (SELECT p.key, coalesce(t.text, p.p_name) AS text FROM parts p LEFT JOIN texts t ON t.key = p.key)"),
    "grouped": (["base"], """
        SELECT b.*, c.c_mktsegment AS grp, c.c_nationkey FROM base b JOIN orders o ON o.o_orderkey = b.sample_no
        JOIN customer c ON c.c_custkey = o.o_custkey"""),
    "wopt": (["base"], f"""
        SELECT dataset, key || '_W' || wave AS key, 'ATP W' || wave AS survey, option, n,
               n / sum(n) OVER (PARTITION BY key, wave) AS p_human FROM (
        SELECT dataset, key, {case('year(ts)', WAVES, '99')} AS wave, option, count(*) AS n FROM base GROUP BY ALL)"""),
}


def sql(body: str, *ctes: str, **extra: str) -> str:
    """``body`` with the shared expressions it needs, in dependency order, then its own."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in ctes:
        need(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({t.strip()})" for n, t in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
