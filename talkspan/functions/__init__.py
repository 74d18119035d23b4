"""Part of talkspan."""
