"""Experiment control: queue, ledger, planner and sweeps as table transitions."""
