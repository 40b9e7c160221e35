"""Settings: sections that flatten into one, policies and the punishment ladder, all checked when they are made."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

#: Fixed values.
CONTENT_LIMIT, PATTERN_LIMIT, EVIDENCE_LIMIT, REASON_LIMIT, NOTICE_LIMIT = 2000, 500, 2000, 80, 160
MAX_SIGNALS = 20
DEFAULT_MUTE_MINUTES = 10
REVIEW_WINDOW_MS = 24 * 3_600_000
STATE_IDLE_MS = 2 * 3_600_000
REVIEW_ATTEMPTS, REVIEW_TIMEOUT_S, REVIEW_BACKOFF_MS, REVIEW_CAPACITY, REVIEW_CONCURRENCY = 3, 8, 250, 100, 2
RULES_TTL_S, RETENTION_EVERY_S = 30, 6 * 3600
#: Least and greatest value of each numeric setting, null where there is none.
RANGES = {
    "flood_rate_per_minute": (1, 240), "flood_burst_allowance": (1, 50), "flood_cooldown_seconds": (10, 3600), "offense_window_hours": (1, 168),
    "audit_retention_days": (1, None),
}
LEVEL_RANGES = {"offense_count": (1, 100), "mute_minutes": (1, 10_080)}
WORDLIST_BYTES, WORDLIST_LINES, WORDLIST_PATTERN = 2 * 1024 * 1024, 100_000, 200
PRESETS = {
    "relaxed": (24, 12, 90_000, 24),
    "balanced": (15, 8, 60_000, 24),
    "strict": (12, 6, 45_000, 24),
}
DEFAULT_LEVELS = [
    {
        "offense_count": 1, "action": "warn", "mute_minutes": 10,
        "template": "{at} {type}提醒：{evidence}\n消息内容：{content}\n当前同类违规 {offenseCount} 次。",
    },
    {
        "offense_count": 3, "action": "mute", "mute_minutes": 10,
        "template": "{at} 因{type}已被禁言 {muteMinutes} 分钟。\n检测证据：{evidence}\n消息内容：{content}\n当前同类违规 {offenseCount} 次。",
    },
    {
        "offense_count": 5, "action": "mute", "mute_minutes": 60,
        "template": "{at} 因多次{type}已被禁言 {muteMinutes} 分钟。\n检测证据：{evidence}\n消息内容：{content}\n当前同类违规 {offenseCount} 次。",
    },
]


def clamp_integer(value: float, least: int, most: int) -> int:
    """Rounds halves up, then limits."""
    return min(most, max(least, math.floor(value + 0.5)))


@dataclass(frozen=True)
class Level:
    level: int
    offense_count: int
    action: str
    mute_minutes: int
    template: str


def ladder(levels: list[dict] | None = None) -> tuple[Level, ...]:
    """At most ten levels by threshold, renumbered from 1; an empty list disables the ladder."""
    given = DEFAULT_LEVELS if levels is None else levels
    made = []
    for i, x in enumerate(given[:10]):
        action = x.get("action") if x.get("action") in ("mute", "kick") else "warn"
        count = clamp_integer(x["offense_count"] if x.get("offense_count") is not None else i + 1, 1, 100)
        minutes = clamp_integer(x["mute_minutes"] if x.get("mute_minutes") is not None else 10, 1, 10_080)
        made.append((count, i, action, minutes, x.get("template") or ""))
    made.sort(key=lambda x: x[:2])
    return tuple(Level(k + 1, c, a, m, t) for k, (c, _, a, m, t) in enumerate(made))


@dataclass(frozen=True)
class Policy:
    rate: int = 15
    burst: int = 8
    cooldown_ms: int = 60_000
    window_ms: int = 24 * 3_600_000
    levels: tuple[Level, ...] = field(default_factory=ladder)

    @property
    def interval_ms(self) -> float:
        return 60_000 / max(1, self.rate)

    @property
    def tolerance_ms(self) -> float:
        return max(0, self.burst - 1) * self.interval_ms

    @property
    def key(self) -> str:
        """Changes whenever any setting of the policy does."""
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


@dataclass(frozen=True)
class Config:
    guild_ids: tuple[str, ...] = ()
    enabled: bool = True
    admin_user_ids: tuple[str, ...] = ()
    governance_preset: str = "balanced"
    behavior_detection_enabled: bool = True
    content_detection_enabled: bool = True
    flood_rate_per_minute: float = 15
    flood_burst_allowance: float = 8
    flood_cooldown_seconds: float = 60
    offense_window_hours: float = 24
    punishment_levels: list[dict] | None = None
    audit_retention_days: float = 30
    ai_review_enabled: bool = False
    api_key: str = ""
    model: str = ""
    signal: str = ""
    bot_name: str = ""
    welcome_message: str = "{username}，欢迎加入本群，我是群管家 {botName}。"
    leave_message: str = "{userId} 退出了群聊。"

    def __post_init__(self):
        if self.governance_preset not in (*PRESETS, "custom"):
            raise ValueError(f"unknown preset {self.governance_preset!r}")

    def checked(self) -> Config:
        """The settings themselves; ValueError where a value is out of its range or a level is not one."""
        for name, bounds in RANGES.items():
            _in_range(name, getattr(self, name), bounds)
        levels = self.punishment_levels or []
        if len(levels) > 10:
            raise ValueError("there may be ten punishment levels")
        for level in levels:
            if level.get("offense_count") is None or level.get("action") not in ("warn", "mute", "kick"):
                raise ValueError(f"a punishment level needs offense_count and an action of warn, mute, kick: {level!r}")
            for name, bounds in LEVEL_RANGES.items():
                if level.get(name) is not None:
                    _in_range(name, level[name], bounds)
        return self

    def policy(self) -> Policy:
        levels = ladder(self.punishment_levels)
        if self.governance_preset != "custom":
            rate, burst, cooldown, hours = PRESETS[self.governance_preset]
            return Policy(rate, burst, cooldown, hours * 3_600_000, levels)
        return Policy(
            clamp_integer(self.flood_rate_per_minute, 1, 240),
            clamp_integer(self.flood_burst_allowance, 1, 50),
            clamp_integer(self.flood_cooldown_seconds, 10, 3600) * 1000,
            clamp_integer(self.offense_window_hours, 1, 168) * 3_600_000,
            levels,
        )

    def in_scope(self, guild_id: str) -> bool:
        return not self.guild_ids or guild_id in self.guild_ids


def _in_range(name: str, value, bounds: tuple) -> None:
    least, most = bounds
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value < least or most is not None and value > most:
        raise ValueError(f"{name} must be a number from {least}" + (f" to {most}" if most is not None else "") + f", not {value!r}")


def flatten(sections: dict) -> Config:
    """A Config of nested sections; of equal names the last section's value holds, unknown names and values out of range are errors."""
    flat: dict = {}
    for value in sections.values():
        flat |= value or {}
    return Config(**flat).checked()
