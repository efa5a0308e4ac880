"""Which columns hold names and which hold samples."""

from __future__ import annotations


def lipid_column(columns: list[str], wanted: str | int | None = None) -> int:
    """0-based position of the name column: the first, a position, or the first of that exact name."""
    if wanted is None:
        wanted = 0
    if isinstance(wanted, int):
        if not 0 <= wanted < len(columns):
            raise ValueError(f"column {wanted} is out of range: there are {len(columns)} columns")
        return wanted
    if wanted not in columns:
        raise ValueError(f"column {wanted!r} is not among {', '.join(columns)}")
    return columns.index(wanted)


def sample_columns(columns: list[str], lipid: int, wanted: list[str | int] | str | int | None = None) -> list[int]:
    """Positions of the sample columns: all but the name column, or those asked for; blank headers go."""
    if wanted is None:
        found = [k for k in range(len(columns)) if k != lipid]
    else:
        asked = [wanted] if isinstance(wanted, (str, int)) else wanted
        found = [lipid_column(columns, w) for w in asked]
    return [k for k in found if columns[k].strip()]
