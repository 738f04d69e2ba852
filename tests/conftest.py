import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    yield session
    session.stop()


def random_bars(n: int, seed: int = 42, symbol: str = "S", tf: str = "1h", start: str = "2024-01-01", decimals: int | None = 2) -> pd.DataFrame:
    """Random-walk bars with consistent high and low."""
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(size=n) * 0.5)
    open_ = np.r_[close[0], close[:-1]] + rng.normal(size=n) * 0.1
    high = np.maximum(open_, close) + rng.random(n) * 0.4
    low = np.minimum(open_, close) - rng.random(n) * 0.4
    out = pd.DataFrame({
        "symbol": symbol, "tf": tf, "ts": pd.date_range(start, periods=n, freq=tf), "open": open_, "high": high, "low": low, "close": close,
        "volume": rng.integers(1, 100, n).astype(float), "ix": np.arange(n),
    })
    return out if decimals is None else out.round(decimals)


def bars_of(rows, symbol: str = "S", tf: str = "1h", start: str = "2024-01-01") -> pd.DataFrame:
    """Bars from (open, high, low, close) rows."""
    out = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
    out.insert(0, "ts", pd.date_range(start, periods=len(out), freq=tf))
    out.insert(0, "tf", tf)
    out.insert(0, "symbol", symbol)
    return out.assign(volume=1.0, ix=range(len(out)))


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
