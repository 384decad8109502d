"""op5: documents mixed to target weights over domains, languages and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import mixing
from rillway.llm.common import materialize, table

#: Sources by domain; others are `other`.
DOMAINS = {"web": [f"src{i}" for i in range(10)], "books": [f"src{i}" for i in range(10, 15)], "forums": [f"src{i}" for i in range(15, 18)]}
#: Weights by level and value; 1 where none is given.
WEIGHTS = {"domain": {"web": 3, "books": 4, "forums": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}
PERCENT, MAX_EPOCHS, SEED = 60, 2, 17


def domain() -> Column:
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(sources), name).otherwise(out)
    return out


def levels() -> dict[str, Column]:
    return {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.tokens_of("text").alias("n_tokens"))
    docs = materialize(docs, "tokens")
    mixed = mixing.mix_epochs(docs, levels(), WEIGHTS, PERCENT, MAX_EPOCHS, SEED, tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "epoch", domain().alias("domain"), "lang", "source", "n_tokens")


def sql(percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    dom = "CASE " + " ".join(f"WHEN source IN ({quoted(s)}) THEN '{d}'" for d, s in DOMAINS.items()) + " ELSE 'other' END"
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if WEIGHTS.get(level) else "1"
    parts = [
        f"""docs AS (SELECT doc_id, {dom} AS domain, lang AS lang0, source AS source0, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
  CAST(coalesce((strlen(text) + 3) // 4, 0) AS BIGINT) AS n_tokens FROM documents)""",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS cap FROM docs GROUP BY ALL)",
        f"top AS (SELECT CAST(least(floor(sum(tokens) * {percent} / 100), sum(cap)) AS BIGINT) AS budget FROM leaves)",
    ]
    names = ["domain", "lang", "source"]
    above = "top"
    for d, level in enumerate(names):
        here, parents = ", ".join(names[: d + 1]), ", ".join(names[:d])
        by = f"PARTITION BY {parents}" if parents else ""
        join = f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"
        parts += [
            f"a{d} AS (SELECT n.*, budget AS given, {weight(level)} AS w FROM (SELECT {here}, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY ALL) n {join})",
            f"""b{d} AS (SELECT *, CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
  CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM a{d} WINDOW o AS ({by} ORDER BY cap / w, {level}))""",
            f"c{d} AS (SELECT *, cap * left_w <= w * (given - used) AS isfull FROM b{d})",
            f"""e{d} AS (SELECT *, min(CASE WHEN NOT isfull THEN used END) OVER ({by}) AS used0, max(CASE WHEN NOT isfull THEN left_w END) OVER ({by}) AS left0 FROM c{d})""",
            f"f{d} AS (SELECT {here}, CAST(CASE WHEN isfull THEN cap ELSE w * (given - used0) // left0 END AS BIGINT) AS budget FROM e{d})",
        ]
        above = f"f{d}"
    parts += [
        f"plan AS (SELECT domain, lang, source, budget // tokens AS fulls, budget % tokens AS rest FROM leaves JOIN {above} USING (domain, lang, source) WHERE tokens > 0)",
        f"""keyed AS (SELECT d.*, fulls, rest, CAST('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(fulls AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS key
  FROM docs d JOIN plan USING (domain, lang, source))""",
        "summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)",
        "chosen AS (SELECT *, fulls + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, CAST(e.epoch AS INTEGER) AS epoch, domain, lang0 AS lang, source0 AS source, n_tokens FROM chosen, LATERAL (SELECT unnest(range(times)) AS epoch) e"


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {"op5_mixing": sql()}
