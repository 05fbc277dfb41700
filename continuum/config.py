"""Study settings. One frozen object per study; two presets."""

from __future__ import annotations

from dataclasses import dataclass


# They must equal the published study for results to agree.
@dataclass(frozen=True)
class StudyConfig:
    position_pcts: tuple[float, ...] = (0.40, 0.60, 0.80, 0.90)
    n_continuations: int = 5
    temperature: float = 1.2
    top_p: float = 0.95
    min_story_id: int = 0          # inclusive
    max_story_id: int = 200        # exclusive
    max_words: int = 5000          # inclusive
    min_sentences: int = 5         # inclusive
    context_length: int = 32768
    tokens_per_word: float = 1.3
    buffer_mult: float = 1.3
    token_floor: int = 100
    token_clamp: int = 4096
    thinking_tokens: int = 2048    # added to budget and floor when reasoning is stripped
    thinking_clamp: int = 8192


CURRENT = StudyConfig()
OLD = StudyConfig(position_pcts=(0.20, 0.40, 0.60, 0.80, 0.90), n_continuations=20)
