"""Groups of rows in a sorted partition, as they stream by."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """From batches sorted by key, frames in which no group is cut. Only the group at hand is held back."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        if held and held[0][key].iloc[0] == last and pdf[key].iloc[0] == last:
            held.append(pdf)
            continue
        cut = int(pdf[key].searchsorted(last))
        if held or cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)
