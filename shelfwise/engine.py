"""A session over a library: the chosen view, sort and query, and what the grid shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Catalog, visible
from .operators import ordering, views
from .plans.library_search import search_items

SORTS = ["date", "name", "size", "modified"]
GROUPINGS = ["folder", "day", "month", "year", "none"]


class Engine:
    """View state plus cached counts; a setter that fails leaves the state as it was."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.view, self.argument, self.sort, self.grouping = "all", None, "date", "folder"
        self._counts: tuple[int, dict] | None = None
        self._grid: tuple[tuple, DataFrame] | None = None

    def set_view(self, name: str, argument=None) -> None:
        if name not in views.VIEWS:
            raise ValueError(f"no view {name!r}")
        self.view, self.argument = name, argument

    def set_search(self, text: str) -> None:
        """A blank query goes back to everything."""
        self.view, self.argument = ("search", text) if text.strip() else ("all", None)

    def set_sort(self, setting: str, grouping: str = "folder") -> None:
        """Unknown settings are the default's."""
        self.sort = setting if setting.lstrip("-") in SORTS and setting.count("-") <= 1 else "date"
        self.grouping = grouping if grouping in GROUPINGS else "folder"

    def rows(self) -> DataFrame:
        return search_items(self.catalog, self.argument) if self.view == "search" else views.view(self.catalog, self.view, self.argument)

    def grid(self) -> DataFrame:
        """The view's rows in order, placed and written once for each state of view and catalog; pages and sections read it."""
        state = (self.catalog.version, self.view, self.argument, self.sort, self.grouping)
        if self._grid is None or self._grid[0] != state:
            self._grid = state, ordering.written(self._placed(), "grid")
        return self._grid[1]

    def _placed(self) -> DataFrame:
        """The view's rows with their folder's path and ``pos``. Search places folders by all of their rows."""
        folders = self.catalog["folders"]
        paths = folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path"), "watched_id")
        # Roots that cannot be reached show nothing; folders of no known root are shown.
        offline = self.catalog["watched_folders"].filter("not online").select(F.col("id").alias("watched_id"))
        away = paths.join(offline, "watched_id", "left_semi").select("folder_id")
        paths = paths.drop("watched_id")
        shown = self.rows().join(away, "folder_id", "left_anti").join(paths, "folder_id", "left")
        within = visible(self.catalog["items"]).join(paths, "folder_id", "left") if self.view == "search" else None
        return views.placed(shown, self.sort, within=within, grouping="folder" if self.grouping == "folder" else "none")

    def sections(self) -> DataFrame:
        """Runs of the grid: by folder, by period, or none at all."""
        grid = self.grid()
        if self.grouping == "none":
            return ordering.sections(grid, F.lit(0), "taken_at")
        key = F.col("folder_path") if self.grouping == "folder" else F.date_trunc(self.grouping, F.timestamp_seconds("taken_at"))
        return ordering.sections(grid, key, "taken_at")

    def page(self, offset: int, count: int) -> DataFrame:
        return ordering.page(self.grid(), offset, count)

    def change(self, name: str, rows: DataFrame) -> int:
        """Commit table ``name`` as ``rows``, which say row by row whether they ``changed``; the number that did.

        Where none did, nothing is committed, so neither grid nor counts are made anew.
        """
        n = rows.filter("changed").count()
        if n:
            self.catalog.commit(**{name: rows.drop("changed")})
        return n

    def counts(self) -> dict:
        """Starred, videos, hidden and duplicates in one pass each, kept until the catalog changes."""
        if self._counts is None or self._counts[0] != self.catalog.version:
            items = self.catalog["items"].filter("missing_since is null")
            n = items.agg(F.count_if(~F.col("hidden")).alias("all"), F.count_if(~F.col("hidden") & (F.col("rating") >= 1)).alias("starred"), F.count_if(~F.col("hidden") & (F.col("kind") == 1)).alias("videos"), F.count_if("hidden").alias("hidden")).first().asDict()
            n["duplicates"] = views.duplicate_ids(items.filter("not hidden"), ["content_hash", "similar_group"]).count()
            self._counts = (self.catalog.version, n)
        return self._counts[1]
