"""Readers: raw submissions, stored layers, the staging projection and the test posts."""
