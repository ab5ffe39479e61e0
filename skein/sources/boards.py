"""One page of a board: fetched, parsed, and fetched once more if nothing was found."""

from __future__ import annotations

from collections.abc import Callable


def scan_board(fetch: Callable[[], str], parse: Callable[[str], list[dict]], limit: int, dump: Callable[[str], None] = lambda page: None) -> list[dict]:
    """At most ``limit`` rows of a page.  A page without rows may be one that
    only sets cookies, so it is fetched a second time; without rows again it is
    dumped and the list is empty."""
    page = ""
    for _ in range(2):
        page = fetch()
        rows = parse(page)
        if rows:
            return rows[:limit]
    dump(page)
    return []
