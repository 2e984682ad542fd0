"""Settings shared by the operators.

All values are plain Python scalars; they become literals in the query plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Texts and codes that decide the produced samples.
# ---------------------------------------------------------------------------
PROMPT_WITH_FRONTIERS = (
    "You are an autonomous navigation assistant. "
    "Your task is to <instruction>. "
    "Where should you go next to stay on track? "
    "Select the most suitable waypoint coordinate from the following <frontiers_coord>. "
    "If no suitable coordinate is found, output the action command. "
    "If the destination is visible, output the coordinates of the target point directly. "
    "Please output STOP when you have successfully completed the task. "
    "These are your historical observations: <history>. "
    "<conjunction><image>."
)
PROMPT_WITHOUT_FRONTIERS = (
    "You are an autonomous navigation assistant. "
    "Your task is to <instruction>. "
    "Where should you go next to stay on track? "
    "Enter the action command directly. "
    "If you can see the endpoint, enter the coordinates of the target point. "
    "Please output STOP when you have successfully completed the task. "
    "These are your historical observations: <history>. "
    "<conjunction><image>."
)
HISTORY_SENTENCE = "These are your historical observations: <history>. "
CONJUNCTIONS = (
    "Now observe: ",
    "Current view: ",
    "Looking ahead: ",
    "What you see now: ",
    "Your current observation: ",
)
FRONTIER_PREFIX = "<frontiers_coord>"
TARGET_PREFIX = "<target>"
ACTION_PREFIX = "<action>"
STOP_TEXT = "STOP"
IMAGE_TOKEN = "<image>"
ACTION_NAMES = ("STOP", "FORWARD", "TURN_LEFT", "TURN_RIGHT")
ACTION_SYMBOLS = ("⏹", "↑", "←", "→")
STOP_ACTION = 0
VISIBLE = 0
CURRENT_SCHEMA = 3
IGNORE_LABEL = -100
OUTPUT_MODES = ("frontier", "target", "action", "stop")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class NavConfig:
    """Sample-building settings; the defaults are those of the dataset."""

    prompt_with_frontiers: str = PROMPT_WITH_FRONTIERS
    prompt_without_frontiers: str = PROMPT_WITHOUT_FRONTIERS
    conjunctions: tuple[str, ...] = CONJUNCTIONS
    frontier_prefix: str = FRONTIER_PREFIX
    target_prefix: str = TARGET_PREFIX
    action_prefix: str = ACTION_PREFIX
    prefix_trainable: bool = True
    use_action_symbols: bool = False
    distance_threshold: float = 2.0
    pixel_distance_threshold: float = 100.0
    max_history_frames: int = 8
    max_action_lookahead: int = 3
    image_token: str = IMAGE_TOKEN
    image_ext: str = "jpg"
    max_seq_length: int = 4096
    seed: int = 42

    @classmethod
    def training(cls, **changes) -> "NavConfig":
        """Settings of the training and evaluation runs (3 m match radius)."""
        return replace(cls(distance_threshold=3.0), **changes)


@dataclass(frozen=True)
class VideoConfig:
    """Video-conversation settings."""

    num_frames: int = 8
    image_token: str = IMAGE_TOKEN
