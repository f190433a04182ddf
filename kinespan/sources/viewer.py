"""A self-contained page that shows how two sequences align."""

from __future__ import annotations

import html
import json

import numpy as np

from kinespan.operators.dtw import SUPPORT, frame_costs, path


def payload(a: np.ndarray, b: np.ndarray, support: float = SUPPORT) -> dict:
    """Path and costs of two sequences (frames, joints, 2): costs at 4 decimals, -1 where frames cannot meet."""
    cost = frame_costs(a, b, support)
    shown = np.where(np.isfinite(cost), np.round(cost, 4), -1.0)
    clean = lambda s: np.where(np.isfinite(s), np.round(s, 4), None).tolist()
    return {"path": [list(p) for p in path(cost)], "costs": shown.tolist(), "a": clean(a), "b": clean(b)}


def page(title: str, data: dict) -> str:
    """The page: a grid of costs with the path on it. It loads nothing from elsewhere."""
    content = json.dumps(data, allow_nan=False).replace("</", "<\\/")
    return f"""<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><canvas id="grid"></canvas><script>
const data = {content};
const cell = 10, rows = data.costs.length, columns = rows ? data.costs[0].length : 0, grid = document.getElementById('grid');
grid.width = columns * cell; grid.height = rows * cell;
const pen = grid.getContext('2d'), top = Math.max(1e-9, ...data.costs.flat());
data.costs.forEach((row, i) => row.forEach((c, j) => {{
  pen.fillStyle = c < 0 ? '#444' : `hsl(210, 60%, ${{95 - 65 * c / top}}%)`;
  pen.fillRect(j * cell, i * cell, cell, cell);
}}));
pen.fillStyle = '#d33';
data.path.forEach(([i, j]) => pen.fillRect(j * cell + 3, i * cell + 3, cell - 6, cell - 6));
</script></body></html>"""
