"""The corpus queries and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op9_nearest
from .backoff import ORACLE as BACKOFF
from .backoff import op2_backoff
from .bpe import op3_sentencepiece
from .licences import ORACLE as LICENCES
from .licences import op4_licences
from .linededup import op8_line_dedup
from .mining import ORACLE as MINING
from .mining import op12_hard_negatives
from .mixing import ORACLE as MIXING
from .mixing import op7_mixing
from .quality import op1_quality
from .secrets import op10_secrets
from .sharding import ORACLE as SHARDING
from .sharding import op11_sharding
from .simhash import op6_simhash
from .whitening import op13_whitening
from .wordpiece import op5_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_backoff, op3_sentencepiece, op4_licences, op5_token_counts, op6_simhash, op7_mixing, op8_line_dedup, op9_nearest, op10_secrets, op11_sharding, op12_hard_negatives, op13_whitening)
}
ORACLES: dict[str, str] = {"op2_backoff": BACKOFF, "op4_licences": LICENCES, "op7_mixing": MIXING, "op11_sharding": SHARDING, "op12_hard_negatives": MINING}
