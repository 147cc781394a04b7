"""Small DataFrame helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.operators.components import connected
from riskledger.operators.frames import merged
from riskledger.session import checkpointed, scratch

__all__ = ["carried", "checkpointed", "connected", "if_small", "merged", "scratch"]

#: Rows of a few numbers that may be broadcast.
FEW = 10_000


def if_small(df: DataFrame) -> DataFrame:
    """``df`` stored, with a broadcast hint if it has at most FEW rows; larger ones are joined by shuffle."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(FEW + 1).count() <= FEW else kept


def carried(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, named row, so that no name of theirs meets a name of the operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
