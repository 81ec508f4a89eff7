"""Whole jobs: the finalization chain and its inputs."""
