"""What is kept of an entity between batches, without a stream."""

import numpy as np
import pandas as pd

from respmosaic.streaming import coverage


class Kept:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def frame(*cells):
    return pd.DataFrame(cells, columns=["item", "value", "listed"])


def counts(state, *frames):
    (out,) = coverage.seen_items(("a",), iter(frames), state)
    return tuple(int(x) for x in out.iloc[0].drop("entity"))


def test_batches_replace_their_items_in_packed_state():
    state = Kept()
    assert counts(state, frame((1, 0.5, True), (1, None, True)), frame((7, 1.0, False))) == (3, 2, 1, 1, 1)
    assert counts(state, frame((1, np.inf, True), (2, 1.0, True))) == (3, 3, 1, 2, 1)
    assert counts(state, frame((np.nan, 1.0, False))) == (3, 3, 1, 2, 1)
    assert all(isinstance(x, bytes) for x in state.get) and list(np.frombuffer(state.get[0], np.int64)) == [1, 2, 7]
