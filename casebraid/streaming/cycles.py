"""WIN-07 as a stream: the visits of cases to units, from keyed state without end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.timeline import ACTIVATING, CONCLUDING

_OUT = "processo long, unidade string, ordem int, entrada long, saida long, segundos long, status string, implicit_close boolean, aberto_por long, fechado_por long, visto long"
_STATE = "cycles int, since long, opened_by long, last_seen long, seen long"


class _Cycles(StatefulProcessor):
    """The state of a case at a unit: how many cycles it had, and when and by what the open one began (null: none is open)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("visit", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cycles, since, opened_by, last, seen = self._state.get() if self._state.exists() else (0, None, None, None, -1)
        out: list[tuple] = []

        def tell(ordem, start, end, until, status, implicit, by, closed_by):
            out.append((key[0], key[1], ordem, start, end, until - start, status, implicit, by, closed_by))

        # only what is not yet known: a batch that is read again changes nothing
        batch = pd.concat(list(rows)).sort_values("ord")
        for t, tipo, source, place in batch[batch["ord"] > seen][["t", "tipo", "source_id", "ord"]].itertuples(index=False, name=None):
            last, seen = t if last is None else max(last, t), place
            if tipo in ACTIVATING:
                if since is not None:
                    tell(cycles - 1, since, t, t, "em_aberto", True, opened_by, None)
                cycles, since, opened_by = cycles + 1, t, source
            elif tipo in CONCLUDING:
                if since is not None:
                    tell(cycles - 1, since, t, t, "concluida", False, opened_by, source)
                    since = opened_by = None
                else:
                    cycles += 1
                    tell(cycles - 1, t, t, t, "concluida", False, None, source)
        if since is not None:
            tell(cycles - 1, since, None, last, "em_aberto", False, opened_by, None)
        self._state.update((cycles, since, opened_by, last, seen))
        if out:
            frame = pd.DataFrame(out, columns=["processo", "unidade", "ordem", "entrada", "saida", "segundos", "status", "implicit_close", "aberto_por", "fechado_por"])
            yield frame.astype({"saida": "Int64", "aberto_por": "Int64", "fechado_por": "Int64"}).assign(visto=seen)

    def close(self) -> None:
        pass


def cycles(activities: DataFrame) -> DataFrame:
    """A stream of ordered activities (processo, unidade, ord, t, tipo, source_id) to the cycles that each batch changed.

    The columns are those of the batch operator, and visto: the last ord that the row knows of. A cycle is told again
    whenever it changes, so of one (processo, unidade, ordem) the row with the highest visto counts; merge_into keeps it.
    A case's activities must come in the order of ord; one that comes after a later one of its case and unit is left out.
    Null cases and units have no cycles. Needs the RocksDB state store.
    """
    rows = activities.where("processo is not null and unidade is not null").select("processo", "unidade", "ord", "t", "tipo", "source_id")
    found = rows.groupBy("processo", "unidade").transformWithStateInPandas(_Cycles(), _OUT, "Update", "None")
    return found.select("processo", "unidade", "ordem", "entrada", "saida", F.round(F.col("segundos") / 3600, 4).alias("duracao_horas"), "status", "implicit_close", "aberto_por", "fechado_por", "visto")
