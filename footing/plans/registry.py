"""All layouts by name."""

from __future__ import annotations

from footing.plans import layouts
from footing.plans.layouts import Layout
from footing.plans.two_templates import TWO_TEMPLATES

LAYOUTS = layouts.LAYOUTS | {TWO_TEMPLATES.name: TWO_TEMPLATES}


def layout(name: str) -> Layout:
    found = LAYOUTS.get(name)
    if not isinstance(found, Layout):
        raise LookupError(f"no layout {name!r}; there are {', '.join(sorted(LAYOUTS))}")
    return found
