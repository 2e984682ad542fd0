"""Plain loops over Python lists: what the step operators have to give."""

from __future__ import annotations

import math


def nearest(step):
    """(index, distance) of the candidate nearest to the trajectory point."""
    best = (None, math.inf)
    world, pixel = step["traj_world"], step["traj_px"]
    if world is not None and step["world"]:
        pairs = [(w, world) for w in step["world"]]
    elif pixel is not None and step["px"]:
        pairs = [(p, pixel) for p in step["px"]]
    else:
        pairs = []
    for index, (candidate, goal) in enumerate(pairs):
        if candidate is not None:
            distance = math.dist(candidate, goal)
            if distance < best[1]:
                best = (index, distance)
    return best


def at(values, index):
    return values[index] if index is not None and 0 <= index < len(values) else None


def match(step, version, fall_through):
    """Index of the matched candidate, or None.

    ``fall_through``: whether an expert index out of range is replaced by a search.
    """
    expert = step["expert_idx"]
    if expert is not None and (not fall_through or 0 <= expert < len(step["px"])):
        return expert
    if version >= 3:
        return None
    index, distance = nearest(step)
    limit = 2.0 if step["traj_world"] is not None else 100.0
    return index if index is not None and distance < limit else None


def sees_target(step, version):
    return version >= 3 and step["is_endpoint"] and step["traj_status"] == 0 and step["traj_px"] is not None


def mode(step, version):
    if step["action"] is None:
        return None
    if step["action"] == 0:
        return "stop"
    if step["floor_transition"]:
        return "action"
    if sees_target(step, version):
        return "target"
    return "frontier" if at(step["vis"], match(step, version, True)) == 0 else "action"


def supervised(step, version):
    if step["action"] in (None, 0) or step["floor_transition"]:
        return False
    if sees_target(step, version):
        return True
    index = match(step, version, False)
    return index is not None and 0 <= index < len(step["px"]) and at(step["vis"], index) == 0


def samples(task, version, ahead=3, frames=8):
    """{step: (mode, absorbed, emitted, history)} of the steps that become samples."""
    valid = [i for i, s in enumerate(task) if s["action"] is not None and (version >= 3 or s["action"] != 0)]
    out, place = {}, 0
    while place < len(valid):
        here = task[valid[place]]
        later = [task[i] for i in valid[place + 1 : place + 1 + ahead]]
        absorbed = 1
        if mode(here, version) == "action":
            for step in later:
                if mode(step, version) != "action" or step["action"] != here["action"]:
                    break
                absorbed += 1
        emitted = 1
        for step in later if here["action"] != 0 else []:
            if (
                step["floor_transition"] != here["floor_transition"]
                or supervised(step, version)
                or step["action"] != here["action"]
            ):
                break
            emitted += 1
        shown = valid[:place]
        if len(shown) > frames:
            gap = (len(shown) - 1) / (frames - 1) if frames > 1 else 0
            picks = [int(i * gap) for i in range(frames)]
            if frames > 1:
                picks[-1] = len(shown) - 1
            shown = [shown[i] for i in picks]
        out[valid[place]] = (mode(here, version), absorbed, emitted, shown)
        place += absorbed
    return out
