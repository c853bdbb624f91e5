"""Access tokens for services that hand them out for a while: a helper on the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

# How long before its end a token is renewed, and how long one is taken to last.
MARGIN_SECONDS = 300
LIFE_SECONDS = 90 * 60


@dataclass
class Tokens:
    access: str
    refresh: str


class Session:
    """``token()``: the token held while it lasts, else a refreshed one, else that of a new login; null
    if neither works.  ``login`` and ``refresh`` give tokens or null."""

    def __init__(self, login: Callable[[], Tokens | None], refresh: Callable[[str], Tokens | None], clock: Callable[[], float] = time.monotonic) -> None:
        self.login, self.refresh, self.clock = login, refresh, clock
        self.lock, self.held, self.ends = threading.Lock(), None, 0.0

    def token(self) -> str | None:
        with self.lock:
            if self.held and self.ends > self.clock() + MARGIN_SECONDS:
                return self.held.access
            new = (self.refresh(self.held.refresh) if self.held else None) or self.login()
            if new is None:
                return None
            self.held, self.ends = new, self.clock() + LIFE_SECONDS
            return new.access
