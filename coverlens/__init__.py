"""coverlens: reasoning-coverage analytics (extraction, grading, pass@k, rollout tables) on Spark."""

__version__ = "0.1.0"
