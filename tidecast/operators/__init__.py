"""DataFrame -> DataFrame operators. Series frames are long:
``(repo, metric, ds DATE, y DOUBLE)``; ``KEYS`` identifies one series."""

KEYS = ["repo", "metric"]
