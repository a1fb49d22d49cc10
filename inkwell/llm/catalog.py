"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from inkwell.llm import queries as q

QUERIES = {name: f for name, f in vars(q).items() if name[:1] == "p" and name[1:2].isdigit()}


def __getattr__(name: str) -> dict[str, str]:
    """``SQL``, made when it is asked for: its maps of characters take a look at all of Unicode."""
    if name == "SQL":
        from inkwell.llm.oracles import written_out

        return written_out()
    raise AttributeError(name)
