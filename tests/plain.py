"""Plain versions that the engine is tested against."""

import numpy as np


def fold_loop(u: np.ndarray, p: np.ndarray, users: np.ndarray, posts: np.ndarray, actions: np.ndarray, lr: float, reg: float, most: float) -> None:
    """The fold event by event: what sgd.fold_rows is tested against."""
    lr32, decay = np.float32(lr), np.float32(lr * reg)
    for i, j, act in zip(users, posts, actions):
        a, b = u[i].copy(), p[j].copy()
        for rows, new, where in ((u, a + lr32 * np.float32(act) * b - decay * a, i), (p, b + lr32 * np.float32(act) * a - decay * b, j)):
            n = np.sqrt((new.astype(np.float64) ** 2).sum())
            rows[where] = new * np.float32(most / n) if most > 0 and np.isfinite(n) and n > most else new
