"""A view on a table: cleaning steps, filters and a sort key, none of which touches the original."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation

from ..operators import diagnose, profile, quality, relate
from . import filters as FL
from .codegen import session_lines
from .facets import Facets
from .filters import Filter
from .pages import PAGE_ROWS, Pages, lay_out
from .recipe import Cleaned, Remove, SetType, Step, add_step, apply_steps, observed_effects
from .standalone import script
from .table import ROW, Table


@dataclass(frozen=True)
class Session:
    """Every change gives a new session and runs nothing.

    Asking for a view of raw columns after a step runs a job that decides
    their kinds anew; profiles, findings and spellings run the jobs that they
    consist of.  Steps are replayed from the original.  Filters see the cleaned rows; kinds
    of columns are decided on all of them, so a filter never changes a kind.
    """

    original: Table
    steps: tuple[Step, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: tuple[str, bool] | None = None

    def with_step(self, step: Step) -> Session:
        """One step more.  A duplicates filter ends, as do filters and sorting on a column that is removed."""
        gone = step.column if isinstance(step, Remove) else None
        kept = tuple(f for f in self.filters if not isinstance(f, FL.DuplicatesFilter) and f.column != gone)
        sort = None if self.sort and self.sort[0] == gone else self.sort
        return replace(self, steps=add_step(self.steps, step), filters=kept, sort=sort)

    def without_step(self, k: int) -> Session:
        return replace(self, steps=self.steps[:k] + self.steps[k + 1 :])

    def toggle(self, f: Filter) -> Session:
        return replace(self, filters=FL.toggle(self.filters, f))

    def set_column_filters(self, column: str, *new: Filter) -> Session:
        return replace(self, filters=FL.replace_column(self.filters, column, *new))

    def clear_filters(self) -> Session:
        return replace(self, filters=())

    def cycle_sort(self, column: str) -> Session:
        """Ascending, then descending, then the order of the file."""
        if self.sort is None or self.sort[0] != column:
            return replace(self, sort=(column, False))
        return replace(self, sort=None if self.sort[1] else (column, True))

    def cleaned(self) -> Cleaned:
        retype = any(c.stored == "raw" for c in self.original.columns) and bool(self.steps)
        return apply_steps(self.original, self.steps, infer_types=retype)

    def view(self) -> Table:
        """The rows that steps and filters leave."""
        return FL.apply_filters(self.cleaned().rows(), self.filters)

    def rows(self) -> DataFrame:
        """The view in its order; groups of duplicates lie together if they are filtered for and nothing is sorted."""
        t = self.view()
        if self.sort:
            return FL.sort_rows(t, *self.sort)
        if any(isinstance(f, FL.DuplicatesFilter) for f in self.filters):
            return FL.duplicate_rows(t).orderBy("_group", ROW)
        return FL.sort_rows(t)

    def effects(self) -> DataFrame:
        return self.cleaned().effects()

    def save(self, path: str) -> tuple[str, list[int]]:
        """Write a clean copy beside ``path``: its name, and the effect of each step, observed by the job that writes it."""
        from ..sources.csv import save_clean_copy

        seen = Observation()
        left = self.cleaned().observed(seen)
        # Dealt out first: the sort looks at its input twice, and what is observed should be read once.
        target = save_clean_copy(left.with_df(left.df.repartition(ROW)), path)
        return target, observed_effects(seen)[1]

    def pages(self, folder: str, size: int = PAGE_ROWS) -> Pages:
        """The view laid out in pages below ``folder``, in its order."""
        return lay_out(self.view(), folder, self.sort, size)

    def profile(self) -> DataFrame:
        return profile.profile(self.view())

    def facets(self, names: list[str] | None = None) -> Facets:
        """Profile, histogram, top values and own counts of all columns from one scan; to be used in a ``with``."""
        return Facets(self.cleaned().rows(), self.filters, names)

    def value_counts(self, column: str) -> DataFrame:
        """Counts under the filters of the other columns; filters of whole sets of rows do not count."""
        t = FL.apply_filters(self.cleaned().rows(), FL.without_column(self.filters, column))
        return profile.value_counts(t, column)

    def all_value_counts(self, column: str) -> DataFrame:
        """Counts over all cleaned rows."""
        return profile.value_counts(self.cleaned().rows(), column)

    def findings(self) -> DataFrame:
        return diagnose.findings(self.view())

    def similar_spellings(self) -> DataFrame:
        return quality.spelling_report(self.view())

    def correlations(self) -> DataFrame:
        return relate.top_correlations(self.view())

    def force(self, column: str, kind: str) -> Session:
        return self.with_step(SetType(column, kind))

    def script(self, path: str) -> str:
        """The session as a script that needs PySpark only."""
        return script(self, path)

    def code(self, path: str) -> str:
        """The session as a PySpark script that uses this package."""
        return "\n".join(session_lines(self, path)) + "\n"
