"""Column functions under SQL names (EXT-06)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name(arguments) → type and body; plain SQL, inlined by the optimizer
FUNCTIONS = {
    "severity_rank(s STRING)": ("INT", "CASE s WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"),
    "severity_score(s STRING)": ("DOUBLE", "CASE s WHEN 'critical' THEN 1.0D WHEN 'high' THEN 0.8D WHEN 'low' THEN 0.3D WHEN 'informational' THEN 0.1D ELSE 0.5D END"),
    "norm_port(p STRING)": ("INT", "CASE WHEN try_cast(trim(p) AS INT) BETWEEN 0 AND 65535 THEN try_cast(trim(p) AS INT) END"),
    "ipv4_number(ip STRING)": ("BIGINT", "try_cast(split_part(ip, '.', 1) AS BIGINT) * 16777216 + try_cast(split_part(ip, '.', 2) AS BIGINT) * 65536 + try_cast(split_part(ip, '.', 3) AS BIGINT) * 256 + try_cast(split_part(ip, '.', 4) AS BIGINT)"),
    "is_private_ip(ip STRING)": ("BOOLEAN", "coalesce(ipv4_number(ip) BETWEEN 167772160 AND 184549375 OR ipv4_number(ip) BETWEEN 2886729728 AND 2887778303 OR ipv4_number(ip) BETWEEN 3232235520 AND 3232301055, false)"),
    "host_of(url STRING)": ("STRING", "split_part(split_part(CASE WHEN contains(url, '://') THEN split_part(lower(url), '://', 2) ELSE lower(url) END, '/', 1), ':', 1)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
