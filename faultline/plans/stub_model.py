"""A stand-in for a model: its answer depends on nothing but the prompt."""

import hashlib

# Answers of every kind that the verdict parser has to tell apart.
ANSWERS = [
    '```json\n{"severity": "P2_WARNING", "reason": "slow", "action": "look"}\n```',
    'My verdict: {"severity": "P1_HIGH", "reason": "partly down", "action": "restart"} as asked.',
    '{"severity": "P0_CRITICAL", "reason": "down", "action": "page", "more": {"a": 1}}',
    '{"severity": "P9", "reason": "x", "action": "y"}',
    "cannot say",
    '["P0_CRITICAL"]',
    '{"severity": "P0_CRITICAL", "more": {"a": 1}} and {}',
    '```json\n{"severity": "P3_IGNORE", "reason": "a", "action": "b"}\n```\n```json\n{"severity": "P0_CRITICAL"}\n```',
]


def stub_model():
    def chat(system, user, temperature, max_tokens):
        digit = int(hashlib.md5(user.encode()).hexdigest()[0], 16)
        usage = {"prompt_eval_count": len(user), "eval_count": digit}
        return ANSWERS[digit % len(ANSWERS)], "stub", usage

    return chat
