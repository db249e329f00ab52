"""Fragments of portable SQL for boxes, written apart from the column expressions they check."""


def w(p=""):
    return f"greatest(0, {p}x_max - {p}x_min)"


def h(p=""):
    return f"greatest(0, {p}y_max - {p}y_min)"


def area(p=""):
    return f"({w(p)} * {h(p)})"


def aspect(p=""):
    return f"(CASE WHEN {h(p)} = 0 THEN 0.0E0 ELSE CAST({w(p)} AS DOUBLE) / CAST({h(p)} AS DOUBLE) END)"


def inter(a, b):
    return (
        f"(greatest(0, least({a}x_max, {b}x_max) - greatest({a}x_min, {b}x_min))"
        f" * greatest(0, least({a}y_max, {b}y_max) - greatest({a}y_min, {b}y_min)))"
    )


def iou(a, b):
    total = f"({area(a)} + {area(b)} - {inter(a, b)})"
    return f"(CASE WHEN {total} <= 0 THEN 0.0E0 ELSE CAST({inter(a, b)} AS DOUBLE) / CAST({total} AS DOUBLE) END)"


def contains(a, b):
    return f"(CASE WHEN {area(b)} <= 0 THEN 0.0E0 ELSE CAST({inter(a, b)} AS DOUBLE) / CAST({area(b)} AS DOUBLE) END)"


def clip(v, lo, hi):
    return f"least(greatest({v}, {lo}), {hi})"


def trunc(v):
    return f"CAST(trunc(CAST({v} AS DOUBLE)) AS INT)"


def clamp_select(x1, y1, x2, y2, fw, fh):
    """Four aliased expressions of a clamped box."""
    cx, cy = clip(x1, 0, f"({fw}) - 1"), clip(y1, 0, f"({fh}) - 1")
    return (
        f"{cx} AS x_min, {cy} AS y_min, {clip(x2, f'{cx} + 1', fw)} AS x_max, {clip(y2, f'{cy} + 1', fh)} AS y_max"
    )


def near_edge(p, fw=3840, fh=2160, margin=180):
    return (
        f"({p}x_min <= {margin} OR {p}y_min <= {margin} OR {p}x_max >= {fw - margin} OR {p}y_max >= {fh - margin})"
    )


def match_score(a, b):
    edge = f"({near_edge(a)} OR {near_edge(b)})"
    dx = f"(({a}x_min + {a}x_max) / 2.0E0 - ({b}x_min + {b}x_max) / 2.0E0)"
    dy = f"(({a}y_min + {a}y_max) / 2.0E0 - ({b}y_min + {b}y_max) / 2.0E0)"
    scale = f"greatest(80.0E0, CAST(greatest({w(a)}, {h(a)}, {w(b)}, {h(b)}) AS DOUBLE))"
    factor = f"(CASE WHEN {edge} THEN 3.2E0 * 1.9E0 ELSE 3.2E0 END)"
    center = f"greatest(0.0E0, 1.0E0 - sqrt({dx} * {dx} + {dy} * {dy}) / ({scale} * {factor}))"

    def ratio(x, y):
        return f"(CAST(least({x}, {y}) AS DOUBLE) / CAST(greatest(1, greatest({x}, {y})) AS DOUBLE))"

    size = f"(0.5E0 * {ratio(w(a), w(b))} + 0.5E0 * {ratio(h(a), h(b))})"
    i = iou(a, b)
    return (
        f"(CASE WHEN {i} < (CASE WHEN {edge} THEN 0.0E0 ELSE 0.04E0 END) AND {center} < (CASE WHEN {edge} THEN 0.38E0 ELSE 0.55E0 END)"
        f" THEN 0.0E0 WHEN {edge} THEN 0.45E0 * {i} + 0.45E0 * {center} + 0.10E0 * {size}"
        f" ELSE 0.58E0 * {i} + 0.30E0 * {center} + 0.12E0 * {size} END)"
    )


def quality(p=""):
    return (
        f"({p}score + (CASE WHEN contains({p}source, 'anchor') THEN 0.08E0 WHEN {p}source = 'promo_color_layout' THEN 0.05E0 ELSE 0.0E0 END)"
        f" + least({area(p)} / 120000.0E0, 1.0E0) * 0.08E0"
        f" - (CASE WHEN {aspect(p)} < 0.25 OR {aspect(p)} > 5.5 THEN 0.10E0 ELSE 0.0E0 END))"
    )
