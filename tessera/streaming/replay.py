"""The game as a state machine, replayed from ordered guesses: in batch per game, or on a stream with state per game."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

AGENTS_TO_WIN = 15
TOKENS = 9


@dataclass
class Game:
    """State of one game: cards are revealed per face; a civilian marks the card for the guesser only."""

    roles: dict[int, tuple[str, str]]
    tokens: int = TOKENS
    sudden_death: bool = False
    over: str | None = None
    found: set[int] = field(default_factory=set)
    marked: set[tuple[int, int]] = field(default_factory=set)

    def guess(self, seat: int, card: int) -> str | None:
        """Role that a guess meets: the giver's face decides, so the guesser of seat s reads face 1 - s. None: not playable."""
        if self.over or card in self.found or (card, seat) in self.marked or card not in self.roles:
            return None
        if self.sudden_death and not self.left(seat):
            return None  # who has found all their agents guesses no more
        role = self.roles[card][1 - seat]
        if role == "agent":
            self.found.add(card)
            if len(self.found) == self.total():
                self.over = "victory_sd" if self.sudden_death else "victory"
        elif role == "assassin":
            self.over = "loss_assassin_sd" if self.sudden_death else "loss_assassin"
        else:
            self.marked.add((card, seat))
            if self.sudden_death:
                self.over = "loss_civilian_sd"
            else:
                self.end_turn()
        return role

    def end_turn(self) -> None:
        self.tokens -= 1
        if self.tokens <= 0:
            self.sudden_death = True

    def left(self, seat: int) -> int:
        """Agents that the guesser of a seat has still to find."""
        return sum(r[1 - seat] == "agent" and c not in self.found for c, r in self.roles.items())

    def total(self) -> int:
        return sum("agent" in r for r in self.roles.values())


def replay_frame(guesses: pd.DataFrame) -> pd.DataFrame:
    """Outcome of one game's guesses (game_id, ord, seat, card_id, llm_role, human_role, ends_turn; roles of every card in some row)."""
    guesses = guesses.sort_values("ord")
    roles = {int(c): (a, b) for c, a, b in zip(guesses.card_id, guesses.llm_role, guesses.human_role, strict=True)}
    game, played = Game(roles), 0
    for seat, card, ends, real in zip(guesses.seat, guesses.card_id, guesses.ends_turn, guesses.guessed, strict=True):
        if not real or game.over:
            continue
        met = game.guess(int(seat), int(card))
        played += met is not None
        if met == "agent" and ends and not game.over:
            game.end_turn()
    return pd.DataFrame([(guesses.game_id.iloc[0], game.over, len(game.found), max(game.tokens, 0), game.sudden_death, played)], columns=["game_id", "result", "agents_found", "tokens_left", "sudden_death", "n_played"])


SCHEMA = "game_id string, result string, agents_found int, tokens_left int, sudden_death boolean, n_played int"


def replay(guesses: DataFrame) -> DataFrame:
    """One row per game. A game is some hundred rows at most, so its group fits a task."""
    return guesses.groupBy("game_id").applyInPandas(replay_frame, SCHEMA)


def accumulate(key, frames: Iterator[pd.DataFrame], state):
    """For ``applyInPandasWithState``: agents and assassins met so far per game; emits a row whenever a game's rows arrive."""
    found, lost = state.get if state.exists else (0, 0)
    for f in frames:
        found += int((f.result_role == "agent").sum())
        lost += int((f.result_role == "assassin").sum())
    state.update((found, lost))
    yield pd.DataFrame({"game_id": [key[0]], "agents": [found], "assassins": [lost]})


def running_score(reveals: DataFrame) -> DataFrame:
    """Running totals per game over a stream of reveals (game_id, result_role)."""
    return reveals.groupBy("game_id").applyInPandasWithState(accumulate, "game_id string, agents long, assassins long", "agents long, assassins long", "update", "NoTimeout")
