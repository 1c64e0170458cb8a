"""DataFrame operators: verdicts, windows, state, matching, delivery, history, retention."""
