"""Geometry kernels in numpy, one feature at a time; ``rooftide.plans.kernels`` runs them over all features."""
