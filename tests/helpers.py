"""Small fixtures and brute-force answers."""

import contextlib
import io
import math
from datetime import datetime, timedelta

from pathweave.schemas import POINTS

START = datetime(2008, 11, 26, 12, 0, 0)


def points(spark, tracks, user="000"):
    """``{traj_id: [(lat, lon), ...]}`` to a POINTS DataFrame."""
    rows = [
        (user, traj, seq, float(lat), float(lon), 100.0 + seq, START + timedelta(seconds=seq))
        for traj, track in tracks.items()
        for seq, (lat, lon) in enumerate(track)
    ]
    return spark.createDataFrame(rows, POINTS)


def line(n, lat=40.0, lon=116.0, step=1e-4):
    return [(lat + i * step, lon) for i in range(n)]


def metres(lat1, lon1, lat2, lon2):
    """Great-circle distance by the chord between unit vectors."""

    def vector(lat, lon):
        phi, lam = math.radians(lat), math.radians(lon)
        return (
            math.cos(phi) * math.cos(lam),
            math.cos(phi) * math.sin(lam),
            math.sin(phi),
        )

    chord = math.dist(vector(lat1, lon1), vector(lat2, lon2))
    return 2 * 6371000.0 * math.asin(min(1.0, chord / 2))


def nearest(rows, point, k):
    """k nearest distinct positions as (traj, lat, lon) by full sort."""
    best = {}
    for traj, lat, lon in rows:
        best[(lat, lon)] = min(traj, best.get((lat, lon), traj))
    ranked = sorted(
        (round(metres(*point, lat, lon), 5), lat, lon, traj)
        for (lat, lon), traj in best.items()
    )
    return [(traj, lat, lon) for _, lat, lon, traj in ranked[:k]]


def segment_lists(segments):
    """``{(entity, segment): [(lat, lon), ...]}`` with parts joined in order."""
    out = {}
    for row in segments.orderBy("entity_id", "segment_id", "part").collect():
        key = (row.entity_id, row.segment_id)
        out.setdefault(key, []).extend(zip(row.vals_x, row.vals_y))
    return out


def cut(track, breaks):
    """Pieces of ``track`` starting at the given indices, each but the first with
    the point before it in front."""
    edges = [0, *breaks, len(track)]
    return [track[max(a - 1, 0) if a else 0 : b] for a, b in zip(edges, edges[1:])]


def plan_text(df):
    """The formatted physical plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
