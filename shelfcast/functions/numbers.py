"""Null-safe and zero-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_part(value: Column) -> Column:
    """P4, P14. Values below zero become zero; null stays null (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """P19. Quotient that is 0 when the denominator is 0 or either side is null."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def loose_return(quantity: Column) -> Column:
    """P5. Any negative quantity is a return; null is not."""
    return F.coalesce(quantity < 0, F.lit(False))


def strict_return(quantity: Column, sales: Column, cost: Column) -> Column:
    """P6. Return only when quantity, sales and cost are all negative."""
    return (quantity < 0) & (sales < 0) & (cost < 0)


def sample_std(total: Column, squares: Column, count: Column) -> Column:
    """Sample standard deviation from running sums; 0 for fewer than two values."""
    spread = F.greatest(squares - total * total / count, F.lit(0.0))
    return F.when(count > 1, F.sqrt(spread / F.greatest(count - 1, F.lit(1)))).otherwise(F.lit(0.0))


def median_with_zeros(positives: Column, count: Column) -> Column:
    """Median of ``count`` values given only the sorted positive ones; all others are zero.

    ``positives`` must be sorted upward. With z implied zeros the k-th smallest value is 0 for k <= z.
    """
    zeros = count - F.size(positives)

    def kth(rank: Column) -> Column:
        # get() is zero-based and null outside the array, which is exactly the implied zero.
        return F.coalesce(F.get(positives, (rank - zeros - 1).cast("int")), F.lit(0.0))

    low = F.floor((count + 1) / F.lit(2.0))
    high = F.floor((count + 2) / F.lit(2.0))
    return F.when(count > 0, (kth(low) + kth(high)) / 2.0).otherwise(F.lit(0.0))
