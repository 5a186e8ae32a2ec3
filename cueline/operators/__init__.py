"""DataFrame operators over cues, words, turns, frames, plans and pages."""
