"""op12: every vector as four numbers of codebook entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm.vectorcodes import ROUNDS, compress


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The nearest entry of every part: compared in order of distance and number.
NEAREST = """
codes{r} AS (
  SELECT p.vec_id, p.part, p.x, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := e.k)) AS best
  FROM parts p JOIN entries{r} e USING (part) GROUP BY ALL
)"""
#: Each entry as the floor of the mean of its parts; entries without parts stay.
UPDATE = """
entries{s} AS (
  SELECT e.part, e.k, coalesce(m.x, e.x) AS x
  FROM entries{r} e LEFT JOIN (
    SELECT part, k, list(v ORDER BY i) AS x FROM (
      SELECT part, k, i, floor(sum(v) / count(*))::BIGINT AS v
      FROM (SELECT part, best.k AS k, unnest(range(len(x))) AS i, unnest(x) AS v FROM codes{r}) GROUP BY part, k, i
    ) GROUP BY part, k
  ) m USING (part, k)
)"""
ROUND = ",".join(NEAREST.format(r=r) + "," + UPDATE.format(r=r, s=r + 1) for r in range(ROUNDS)) + "," + NEAREST.format(r=ROUNDS)

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {
    "op12_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS x FROM kept, range(4) t(part)
), entries0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256
),{ROUND}, coded AS (
  SELECT vec_id, string_agg(lpad(to_hex(best.k), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM codes{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM entries{ROUNDS}
)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""
}
