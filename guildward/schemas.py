"""Schemas of the engine's tables and its closed value domains (fixed values)."""

from __future__ import annotations

RULES = "id long, guild_id string, scope string, pattern string, enabled boolean, created_by string, created_at timestamp"
AUDITS = (
    "id long, trace_id string, guild_id string, channel_id string, user_id string, message_id string, rule_id long, signal_code string, "
    "source string, pattern string, evidence string, action string, status string, offense_count int, reviewed_by_ai boolean, "
    "content string, created_at timestamp, updated_at timestamp"
)
AUDIT_EVENTS = "id long, trace_id string, stage string, signal_code string, result string, pattern string, evidence string, created_at timestamp"
#: The log of audit states, to which rows are only added.
AUDIT_CHANGES = "trace_id string, status string, action string, offense_count int, reviewed_by_ai boolean, evidence string, updated_ms long"
OFFENSES = (
    "id long, guild_id string, user_id string, category string, offense_count int, last_signal_code string, last_pattern string, "
    "last_action string, created_at timestamp, updated_at timestamp"
)
ACCESS = "id long, guild_id string, user_id string, list_type string, reason string, created_by string, created_at timestamp"
MESSAGES = (
    "message_id string, guild_id string, channel_id string, user_id string, content string, roles array<struct<id:string,name:string>>, t_ms long"
)
SCOPES = ("redline", "sensitive")
LIST_TYPES = ("whitelist", "blacklist")
ACTION_RANK = {"kick": 5, "mute": 4, "delete": 3, "warn": 2, "silent": 1}
SIGNAL_RANK = {"blacklist_user": 9, "redline_keyword": 8, "ai_review": 7, "spam_model": 7, "spam_flood": 6}
CATEGORY = {"content": "内容违规", "behavior": "行为违规", "access": "名单管控"}
MANUAL_CATEGORY = "手动处置"
LABELS = ("不违规", "普通广告", "黑产广告", "谩骂引战", "低俗色情", "博彩", "欺诈")
SCOPE_NAMES = {"redline": "红线", "sensitive": "敏感"}
ACTION_NAMES = {"warn": "警告", "delete": "撤回", "mute": "禁言", "kick": "踢出"}
OTHER_ACTION_NAME = "记录"
#: Labels of the console (fixed values).
LABELS_OF = {
    "signal": {
        "blacklist_user": "黑名单", "redline_keyword": "红线词", "sensitive_keyword": "敏感词", "spam_model": "违规消息检测模型", "ai_review": "AI 复核",
        "spam_flood": "刷屏", "similar_repeat": "相似复读", "manual_action": "手动处置",
    },
    "action": {"silent": "放行", "warn": "警告", "delete": "撤回", "mute": "禁言", "kick": "踢出"},
    "status": {"pending": "待复核", "confirmed": "已确认", "dismissed": "已排除", "skipped": "未复核", "failed": "复核失败", "duplicate": "重复任务"},
    "stage": {"access": "名单检查", "keyword": "关键词检测", "behavior": "行为检测", "spam_model": "本地模型", "ai_review": "AI 复核", "decision": "最终裁决"},
    "result": {
        "hit": "命中", "pass": "放行", "review": "待复核", "action": "直接处置", "pending": "处理中", "confirmed": "确认违规", "dismissed": "排除违规",
        "skipped": "跳过", "failed": "失败", "duplicate": "重复任务",
    },
}
PRIVILEGED_ROLES = ("owner", "admin", "administrator")
