"""Pixel expressions: luma, thresholds, half precision, normalisation. Column in, column out, inside generated code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Default thresholds, weights and rounding of the integer luma, weights of the colour transform, channel means
# and deviations, and the wording of decisions.
WHITE, BLACK, REJECT = 230, 25, 0.9
LUMA_R, LUMA_G, LUMA_B, LUMA_HALF, LUMA_BITS = 19595, 38470, 7471, 32768, 16
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 1.402, 0.344136, 0.714136, 1.772
MEANS, STDS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SELECTED = "selected (white: %.2f, black: %.2f)"
TOO_WHITE = "discarded (reason: white_ratio %.2f >= {})"
TOO_BLACK = "discarded (reason: black_ratio %.2f >= {})"
FAILED = "discarded (reason: error processing patch)"


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of 8-bit channels. The sum stays under 2^31, so ints suffice."""
    return F.shiftright(r * F.lit(LUMA_R) + g * F.lit(LUMA_G) + b * F.lit(LUMA_B) + F.lit(LUMA_HALF), LUMA_BITS)


def is_white(gray: Column, threshold: int = WHITE) -> Column:
    return gray > F.lit(threshold)


def is_black(gray: Column, threshold: int = BLACK) -> Column:
    return gray < F.lit(threshold)


def keeps(white: Column, black: Column, total: Column, reject: float = REJECT, early_exit: bool = False) -> Column:
    """Neither share reaches reject. Shares are doubles that are divided first, then compared; no pixels: not kept.

    early_exit: black is not looked at where white rejects; the answer is the same."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    if early_exit:
        return F.coalesce(F.when(white / n >= F.lit(reject), F.lit(False)).otherwise(black / n < F.lit(reject)), F.lit(False))
    return F.coalesce((white / n < F.lit(reject)) & (black / n < F.lit(reject)), F.lit(False))


def status(white: Column, black: Column, total: Column, reject: float = REJECT) -> Column:
    """The decision in words; black is named only where white does not already reject."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    w, b = white / n, black / n
    return (
        F.when(n.isNull(), F.lit(FAILED))
        .when(w >= F.lit(reject), F.format_string(TOO_WHITE.format(reject), w))
        .when(b >= F.lit(reject), F.format_string(TOO_BLACK.format(reject), b))
        .otherwise(F.format_string(SELECTED, w, b))
    )


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x))


def rgb_of_ycc(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Full-range YCbCr to clamped RGB, rounded half up."""
    u, v = cb - F.lit(128.0), cr - F.lit(128.0)
    near = lambda x: _clamp(F.floor(x + F.lit(0.5)).cast("int"))
    return near(y + F.lit(RED_CR) * v), near(y - F.lit(GREEN_CB) * u - F.lit(GREEN_CR) * v), near(y + F.lit(BLUE_CB) * u)


def normalise(value: Column, mean: float = MEANS[0], std: float = STDS[0]) -> Column:
    return (value - F.lit(mean)) / F.lit(std)


def luma_half():
    """Luma in half precision, unrounded and rounded half-even, as a vectorised function of three int columns."""
    @F.pandas_udf("half double, rounded int")
    def run(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        h = [s.to_numpy().astype(np.float16) for s in (r, g, b)]
        out = h[0] * np.float16(0.299) + h[1] * np.float16(0.587) + h[2] * np.float16(0.114)
        return pd.DataFrame({"half": out.astype(np.float64), "rounded": np.rint(out).astype(np.int32)})

    return run
